"""Word lists and idiom families for scoring abusive, hateful and sexual text.

All entries are lower case and compared with text from which disguises have been removed.  They are
starting points of general English and a few other languages; operators take more words as a table.
"""

INSULT_NOUNS = """
arsehole asshole bastard bitch bully bum clown coward creep cretin cunt degenerate dickhead dimwit dipshit
douchebag dork dumbass dunce dweeb failure fool freak garbage goblin halfwit hag hypocrite idiot imbecile
jackass jerk joke leech liar loser lowlife lunatic maggot moron nobody numbskull oaf parasite pathetic pig prick
psycho rat reject retard roach scum scumbag simpleton skank slob slut sucker swine thug tool toad traitor
trash troll twat vermin waste weasel weirdo whore wimp worm wretch
""".split()

INSULT_ADJECTIVES = """
annoying awful brainless clueless creepy cringe deformed dense disgusting dumb fake fat filthy foul gross hideous
horrible hopeless ignorant incompetent lame lazy nasty obnoxious pathetic repulsive revolting rotten sick slimy
smelly spineless stupid talentless terrible trashy two-faced ugly unwanted useless vile weak worthless
""".split()

SEXUAL = """
boobs boob booty busty cock cum dick dildo escort hooker horny kinky milf naked nude nudes nsfw onlyfans orgasm
penis porn pussy rape sex sexting sexy slutty strip thong tits topless vagina xxx blowjob handjob
""".split()

# Words of abuse in other languages, as they stand in running text.
FOREIGN_WORDS = """
abruti asqueroso aptal arschloch basura bâtard cabrón connard connasse cretino crétin dummkopf débile estúpida
estúpido fdp feia feio gilipollas hässlich hurensohn idiota imbécil imbécile imbecil inútil laide lixo loca maricón
merde mierda miststück moche nulle pendejo perra puta puto ridícula ridículo salope schlampe schwein stronza
stronzo stupida stupido tonta tonto trottel vagabunda verpiss wichser zorra
мразь тварь тупой тупая тупица дурак дура идиот идиотка урод уродина сука сволочь дебил дебилка заткнись
ублюдок шлюха ненавижу غبي غبية حقير اخرس أحمق قبيح قبيحة حيوان aptalsın salak çirkin
""".split()
FOREIGN_PHRASES = [
    "nadie te quiere", "qué asco das", "que asco das", "cállate", "callate", "vete a la mierda", "ninguém gosta de você",
    "cala a boca", "cale a boca", "vai se foder", "ferme-la", "ferme la", "ta gueule", "tu es nul", "espèce de", "personne ne t'aime",
    "halt die klappe", "halt die fresse", "niemand mag dich", "du bist hässlich", "geh sterben", "chiudi il becco", "fai schifo",
    "废物", "白痴", "傻逼", "傻瓜", "笨蛋", "蠢货", "去死", "滚开", "贱人", "垃圾人", "恶心的人", "没人喜欢你", "丑八怪",
    "死ね", "バカ", "馬鹿", "ばか", "きもい", "キモい", "ブス", "消えろ", "うざい", "クズ", "くたばれ",
    "никто тебя не любит", "пошёл вон", "пошел вон", "убей себя", "죽어", "바보", "꺼져", "병신", "لا أحد يحبك", "اذهب إلى الجحيم",
]

# Regular expressions over normalised text.  Each names a family of English idioms by its frame and word classes.
_YOU = r"(?:you|u|ya|yall|y'all)"
_YOUR = r"(?:your|ur|yo)"
_ONE = rf"(?:you|u|ya|him|her|them|your|ur|his|all of (?:you|u|them)|(?:this|that|these|those)(?= (?:\w+ )?(?:{'|'.join(INSULT_NOUNS)})))"
_WILL = r"(?:i(?:'?ll| will| would| shall|'d| am going to|'?m going to|'?m gonna|'?m about to| gonna)|we(?:'?ll| will|'?re going to|'?re gonna)|gonna|going to|(?:some|any)(?:one|body) (?:should|needs to|ought to|will|please)|should|let'?s|want to|wanna)"
_HARM = r"(?:slap|punch|beat|kick|hit|smack|hurt|kill|stab|choke|break|destroy|end|shoot|bury|burn|strangle|smash|carve|cut|gut|slice|skin|drown|hang|hunt|crush|murder|butcher|slaughter|poison|torture|maim|throttle|knock|run over|jump|rape|bash|lynch|behead|execute|gas)"
HARM_WORDS = _HARM[3:-1].split("|")
_PEOPLE = r"(?:immigrants?|foreigners?|refugees?|migrants?|people|folks?|kids|women|men|girls|muslims?|jews?|christians?|hindus|gays?|lesbians?|blacks?|whites?|asians?|arabs?|africans?|mexicans?|indians?|gypsies|natives|outsiders|newcomers|minorities|\w+(?:ians?|ans|ish|ese|is))"
_SUBHUMAN = r"(?:vermin|animals?|beasts?|savages?|parasites?|diseases?|plague|cancer|virus|filth|scum|trash|garbage|rats|roaches|cockroaches|pigs|dogs|apes|monkeys|subhumans?|inferior|criminals?|thieves|rapists?|terrorists?|infestation|pests?|leeches|dirt|poison)"

THREATS = [
    rf"\b{_WILL} (?:\w+ ){{0,3}}?{_HARM} (?:up |down |out )?{_ONE}\b",
    rf"\b(?:punch|slap|kick|beat|smack|smash|stab|strangle|choke|carve) (?:you|u|ur|your|him|her)\b",
    rf"\bbreak {_YOUR} (?:\w+ )?(?:teeth|neck|face|legs?|arms?|bones?|jaw|nose|fingers?|skull)",
    r"\bwatch (?:your|ur) back\b", rf"\bi (?:know|found out) where {_YOU}\b", rf"\b(?:we|i)(?: are|'re| am|'m)? coming for {_YOU}\b", rf"\b(?:we|i)(?:'ll| will) find {_YOU}\b",
    rf"\b{_YOU} (?:won'?t|will not|will never) (?:walk|make it|get|see|live|wake)\b", rf"\b{_YOU}(?:'re| are|r)? (?:dead|done for|going to (?:die|pay|regret)|gonna (?:die|pay|regret))\b", rf"\b{_YOU} (?:will|'ll|better) (?:pay|regret|be sorry|sleep with one eye)\b",
    r"\bsleep with one eye open\b", r"\byour days are numbered\b", r"\bsay your prayers\b",
]
WISHES = [
    r"\b(?:go|just|please|should) (?:and )?(?:die|kill yourself|hang yourself|choke|rot)\b", r"\bgo (?:and )?(?:jump|drown|disappear|vanish)\b", r"\bkys\b", r"\b(?:kill|hang|drown|shoot|neck|off|unalive) (?:yourself|urself)\b",
    r"\b(?:drink|swallow|gargle|chug) (?:some )?(?:bleach|poison|acid|antifreeze)\b", r"\b(?:slit|cut) (?:your|ur) (?:wrists?|throat)\b", r"\b(?:go|please|should|just) (?:and )?(?:jump|walk) (?:off|into|in front of) (?:a |the )?(?:bridge|cliff|roof|building|traffic|train|bus)\b",
    r"\b(?:delete|deactivate) (?:your|ur) (?:account|channel|life|existence)\b", r"\bend (?:your|ur) (?:life|existence)\b",
    rf"\b(?:hope|wish|pray) (?:that )?{_YOU} (?:fail|die|choke|fall|suffer|rot|get|lose|never|drown|burn|bleed|crash|were|had never|catch|end up)",
    rf"\b(?:world|life|place|school|class|everything|room) would be (?:so much |much |far )?(?:nicer|better|happier|cleaner) without {_YOU}\b", rf"\b(?:would|will|going to|gonna) (?:even )?(?:miss|mourn|remember|notice if) {_YOU}\b",
    r"\bdo (?:everyone|everybody|us all|the world|us|humanity) a favou?r(?: and)?\b", r"\bshut (?:up|ur mouth|your mouth|it|your trap)\b", r"\b(?:f\*+|fuck|fck|piss|bugger|screw|eff) (?:off|you|u)\b", r"\bgo cry\b",
    r"\b(?:drop|drown|burn|rot) in hell\b", r"\bgo to hell\b", r"\bget cancer\b",
]
DEMEANING = [
    rf"\b(?:nobody|no ?one|not (?:one|a single) \w+|everyone|everybody|the whole \w+|all of us)(?: \w+){{0,5}}? (?:(?:dis)?likes?|loves?|wants?|cares? about|miss(?:es)?|hates?|laughs? at|mocks?|needs?|can stand|respects?|despises?|ignores?|pities|wishes) {_YOU}\b",
    rf"\bno wonder (?:nobody|{_YOU}|your?|ur)\b", rf"\bmore (?:brains?|sense|class|friends|personality|talent|charm|iq|manners|style) than {_YOU}\b", rf"\b(?:wrong|the matter) with {_YOU}\b",
    r"\b(?:mirrors?|cameras?|lens|glass|screens?)\b.{0,25}\b(?:crack|break|broke|shatter)\w*\b.{0,40}\b(?:you|u|your|ur|face)\b", r"\b(?:if i had|with) (?:a|your|ur|that) face\b", r"\b(?:your|ur|that) face\b.{0,30}\b(?:cry|cries|crack|scares?|vomit|puke|sick|bag|nightmares?|blind|onions?)\b",
    rf"\b{_YOUR} (?:mom|mum|mother|dad|father|parents|family|birth)\b.{{0,40}}\b(?:refund|regrets?|ashamed|disappoint\w*|abort\w*|swallow\w*|sorry|mistake|accident|wish\w*|return)\b",
    r"\buglier than\b", r"\b(?:prettier|smarter|cuter|cleaner|smells? better|nicer to look at) than (?:you|u|your|ur|that|this)\b", rf"\bwhat an? \w+ (?:face|excuse|piece|waste)\b", rf"\b{_YOU} (?:should be|are|must be|oughta be) (?:so )?(?:ashamed|embarrassed|sorry)\b",
    r"\b(?:ur|you're|you are|u r) (?:so |too )\w+ it hurts\b", r"\b(?:waste|thief) of (?:space|air|oxygen|life|skin|time)\b", r"\bonly an? \w+ would\b", rf"\b{_YOU}(?:'re| are|r)? (?:nothing|a nobody|a mistake|a disgrace|a disease|an embarrassment|a burden|not wanted|better off dead|a waste)\b",
    rf"\bmakes? me (?:sick|puke|vomit|wanna puke|want to puke)\b", r"\b(?:have|get|got) no (?:friends|life|brain|talent)\b", rf"\bwish(?:es|ed)? {_YOU} (?:were|was|had|would)\b", r"\bhow do you live with yourself\b",
]
HATE = [
    rf"\b(?:{_PEOPLE}) (?:are|is|r) (?:all |just |nothing but |a |an |the |like |worse than |dirty |filthy |such )*{_SUBHUMAN}\b", r"\b(?:are|is) (?:all )?(?:vermin|subhumans?|cockroaches)\b", r"\bshould (?:all )?(?:be|get|go|have been) (?:kept out|locked|deported|shot|gassed|banned|exterminated|wiped|removed|killed|caged|sterili[sz]ed|back|sent)\b",
    r"\bbelongs? (?:in|on|behind) (?:a |the )?(?:cage|zoo|camp|bars|gutter|sewer|kitchen|leash)", r"\b(?:go|send|sent|get|ship) (?:[\w*]+ ){0,6}?(?:back )?(?:to )?where (?:they|you|u|he|she) (?:came|come|comes) from", r"\bi hate (?:all|every|those|these)\b",
    r"\b(?:they|those people|these people|you people) (?:always |all )?(?:ruin|destroy|steal|infest|poison|breed)\b", rf"\bnever trust (?:an? |the |those |these )?{_PEOPLE}\b", r"\bfilthy (?:animals?|people|foreigners?|immigrants?)\b", r"\b(?:like )?your kind\b", r"\b(?:wipe|kick|throw|get) (?:them|those people|all of them|these people) (?:all )?out\b",
    r"\bdeport (?:them|all|every|those)", r"\bgo back to (?:your|ur|their) (?:country|jungle|cave|desert|hole)\b", r"\bmaster race\b", r"\binferior (?:race|people)\b", r"\b(?:don'?t|doesn'?t|do not) belong here\b",
]
SOLICITING = [
    r"\b(?:send|show|trade|dm|swap) (?:me |us )?(?:your |some |ur |more )?(?:nudes?|naked|dirty|sexy|boobs|tits|body|ass|chest|feet)", r"\b(?:naked|nude|horny|sexy|hot) (?:singles|girls|babes|milfs|models|teens|chicks)\b", r"\b(?:pics|photos|videos?|content|nudes) for sale\b", r"\b(?:looking|down|up|dtf|ready) for (?:sex|a hookup|some fun tonight)\b", r"\b(?:grown ?ups|adults|18\+|over 18) only\b",
    r"\btake (?:it|that|everything|your \w+)(?: all)? off\b", r"\bon cam\b", r"\bhit my dms?\b", r"\bwould (?:bang|smash|hit that|do you)\b", rf"\b(?:see|want|imagine|need) {_YOU} (?:naked|nude|in my bed|undressed)\b",
    r"\bso horny\b", r"\bhook ?up (?:tonight|with)\b", r"\bbed with (?:you|me)\b", r"\b(?:suck|ride|lick|touch) (?:my|your|me|on my)\b",
]

# Uses that do not attack anyone; the words in them count for nothing.
HARMLESS = [
    r"\b(?:trash|garbage) (?:can|truck|bag|bin|day|collector|disposal)s?\b", r"\bguinea pigs?\b", r"\bpig ?(?:tails?|let|gy bank)\b", r"\bfat (?:cats?|free|chance)\b", r"\b(?:cats?|dogs?|rats?|pigs?|snakes?|worms?|weasels?|toads?|roach|puppy|puppies|hamsters?) (?:food|lovers?|videos?|breeds?|terriers?|puppies|owners?|shelter|plant|game|years)\b", r"\bdie[- ]hard\b", r"\b(?:im|i'm|am|was|i am|we are|i almost|i) (?:dying|dead|died)\b", r"\bfreak of nature\b",
    r"\bsick (?:moves?|beats?|tricks?|edits?|skills?|flips?|shots?|leave|day|today)\b", r"\b(?:stupid|stupidly|sick|insanely|crazy|disgustingly|filthy) (?:good|talented|fast|funny|cute|rich|easy|smooth)\b", r"\bkilled it\b|\bkilling it\b|\bslayed\b", r"\bhits? (?:so|too|very|really|just)? ?(?:hard|different|home)\b", r"\bhate (?:that|when|how|to) i?\b", r"\bkill the (?:lights|engine|time|mood)\b|\bkill time\b",
    r"\b(?:naked|nude) (?:cakes?|eye|truth|mole rat|lipstick|shades?|color)\b", r"\bugly (?:sweaters?|cry|crying|duckling|betty|sweater party)\b", r"\bclown (?:nose|fish|costume|shoe|car)s?\b", r"\bpunch(?:ing)? (?:a )?.{0,20}\b(?:bag|line|card|hole)\b", r"\bbreast cancer\b", r"\bcocktails?\b", r"\b(?:attack|defen[cs]e|power|damage) (?:level|stat|move|points?|damage|speed)\b",
    r"\bdumb (?:question|luck|bells?)\b|\bdumbbells?\b", r"\bdie in (?:this|that|the) (?:game|level|movie|episode)\b", r"\b(?:hot|corn) dogs?\b", r"\b(?:my|our) (?:\w+ )?(?:rats?|pigs?|worms?|clowns?|weasels?|toads?)\b", r"\b(?:beat|crush|destroy|smash) (?:you|u|them|him|her) (?:at|in|to|on)\b", r"\bhit (?:you|u|me|him|her|them|us) (?:up|back)\b", r"\bpower tools?\b", r"\bfool'?s (?:gold|day)\b|\bapril fools?\b", r"\blame duck\b", r"\bworm ?holes?\b", r"\bcomic strips?\b|\bstrip mall\b",
    r"\bwhy is nobody\b", r"\bnobody (?:is )?(?:talking|explained|knows|told|saw|noticed|asked|said|else)\b", r"\bcall me maybe\b", r"\bsex(?:ual)? (?:education|ed|health)\b", r"(?<!\b(?:only|such) an? )\bjokes?\b(?! (?:of|and everybody|would))", r"\bbeat (?:the|my|that|this|your|their) (?:\w+ )?(?:level|game|boss|record|score|time|team|traffic)\b",
]
# Reported or quoted abuse, objections to it, and mockery of oneself.  A quotation opens where no letter or digit
# precedes and ends where none follows, so that apostrophes within words open and end none.
REPORTING = [
    r"(?<![\p{L}\p{N}])(?:'(?=[\p{L}\p{N}@])(?:[^']|(?<=[\p{L}\p{N}])'(?=[\p{L}\p{N}]))+?'(?![\p{L}\p{N}])|\"[^\"]+\"|“[^”]+”|‘[^’]+’(?![\p{L}\p{N}])|«[^»]+»)",
    r"\b(?:called|calls|calling) (?:me|him|her|my \w+|us|people|them)\b(?: an?)?(?: \w+){1,2}", r"\b(?:don'?t|do not|never|stop) (?:call|calling)\b.*?(?:\bnot ok\b|\bplease\b|$)", r"\b(?:someone|somebody|he|she|they|bullies|people|haters) (?:said|wrote|told|says|commented)\b.{0,50}\b(?:hurts?|me)\b",
    r"\bi(?:'m| am|m) (?:such )?an? (?:\w+ )?\w+ (?:lol|lmao|haha|xd)\b", r"\bi(?:'m| am|m) (?:so|such an?|an?) \w+\b", r"\bstop (?:bullying|calling)\b", r"\b(?:saying|calling|the word|words like) .{1,40} (?:is not|isn'?t|is never) (?:ok|okay|cool|funny|nice)\b",
]
SECOND_PERSON = {"you", "u", "ur", "your", "you're", "youre", "yourself", "urself", "ya", "thou", "du", "dich", "dein", "tu", "te", "toi", "você", "usted", "ты", "тебя", "你", "أنت"}
#: Latin look-alikes of letters of other scripts.
LOOKALIKES = dict(zip("абсԁеһіјкӏмопԛрѕтцѵвхузнгАВСЕНІЈКМОРЅТХУαβεικνορτυχωΑΒΕΗΙΚΜΝΟΡΤΥΧ", "abcdehijklmonqpstuvbxy3hrABCEHIJKMOPSTXYaaeiknoptuxwABEHIKMNOPTYX"))
#: Digits and signs that stand for letters within words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}
