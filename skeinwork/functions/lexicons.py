"""Word lists.  Every operator that uses one takes it as a parameter; these are the defaults."""

# Fixed values.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those",
]
# Words that mark a comment as an attack, as a classifier looks them up.
ATTACK_WORDS = [
    "bitch", "fuck", "shit", "damn", "ass", "nigga", "niggas", "dick", "stupid", "dumb", "idiot", "hate", "kill", "die", "ugly", "fat",
    "retard", "gay", "faggot", "whore", "slut", "cunt",
]

# Words of the rule score of aggression by category.
AGGRESSION = {
    "insults": ["stupid", "idiot", "moron", "dumb", "retard", "loser", "pathetic", "worthless", "useless", "trash", "garbage", "scum", "pig", "dog", "freak", "weirdo", "creep", "psycho", "crazy", "insane", "nuts"],
    "threats": ["kill", "die", "death", "hurt", "harm", "beat", "punch", "kick", "destroy", "ruin", "crush", "smash", "attack", "fight", "violence", "murder", "stab", "shoot", "bomb", "explode", "burn"],
    "profanity": ["fuck", "shit", "damn", "hell", "ass", "bitch", "bastard", "crap", "piss", "cock", "dick", "pussy", "whore", "slut"],
    "discrimination": ["hate", "racist", "sexist", "homophobic", "bigot", "nazi", "fascist", "terrorist", "savage", "primitive", "inferior"],
    "mockery": ["lol", "lmao", "rofl", "haha", "hehe", "joke", "funny", "ridiculous", "laughable", "pathetic", "embarrassing"],
}
# Negations and intensifiers of the rule score, looked for anywhere in the text.
RULE_NEGATIONS = [
    "not", "no", "never", "none", "nothing", "nobody", "nowhere", "neither", "nor", "without", "barely", "hardly", "scarcely", "seldom", "rarely",
    "n't", "don't", "won't", "can't", "shouldn't",
]
RULE_INTENSIFIERS = [
    "very", "extremely", "really", "totally", "completely", "absolutely", "definitely", "certainly", "obviously", "clearly", "seriously",
    "fucking", "damn", "hell", "bloody", "so", "too", "quite",
]
# Words of the second rule score, of presence, by category.
PRESENT = {
    "insults": ["stupid", "idiot", "moron", "dumb", "fool", "loser", "pathetic", "worthless", "useless", "trash", "garbage", "scum"],
    "threats": ["kill", "die", "death", "hurt", "harm", "destroy", "attack", "beat", "punch", "fight", "violence"],
    "profanity": ["damn", "hell", "shit", "fuck", "bitch", "ass", "crap", "suck"],
    "discrimination": ["hate", "racist", "sexist", "discrimination", "prejudice", "bigot", "nazi", "fascist"],
    "mockery": ["lol", "lmao", "rofl", "joke", "funny", "ridiculous", "pathetic", "embarrassing", "shame"],
}
# Strengths of words by class.
STRENGTHS = {
    "aggression": {
        "hate": 0.9, "stupid": 0.8, "idiot": 0.9, "dumb": 0.7, "moron": 0.8, "retard": 0.9, "loser": 0.7, "pathetic": 0.8, "worthless": 0.8, "useless": 0.7,
        "trash": 0.8, "garbage": 0.8, "scum": 0.9, "ugly": 0.7, "fat": 0.6, "gross": 0.7, "disgusting": 0.8, "hideous": 0.8, "repulsive": 0.8, "kill": 1.0,
        "die": 0.9, "death": 0.8, "murder": 1.0, "hurt": 0.7, "pain": 0.6, "suffer": 0.7, "destroy": 0.8, "failure": 0.6, "joke": 0.5, "freak": 0.7,
        "weird": 0.4, "creep": 0.7, "psycho": 0.8, "crazy": 0.5, "fuck": 0.8, "shit": 0.7, "bitch": 0.8, "bastard": 0.8, "damn": 0.5, "hell": 0.5,
        "ass": 0.6, "crap": 0.5, "piss": 0.6, "whore": 0.9, "slut": 0.9,
    },
    "negative": {
        "sad": 0.6, "angry": 0.7, "mad": 0.7, "furious": 0.9, "upset": 0.6, "annoyed": 0.5, "frustrated": 0.6, "disappointed": 0.5, "depressed": 0.7, "miserable": 0.8,
        "terrible": 0.7, "awful": 0.8, "horrible": 0.8, "bad": 0.4, "worse": 0.5, "worst": 0.7, "suck": 0.6, "sucks": 0.6, "sucked": 0.6,
    },
    "positive": {
        "good": 0.5, "great": 0.7, "awesome": 0.8, "amazing": 0.8, "wonderful": 0.8, "fantastic": 0.8, "excellent": 0.8, "love": 0.7, "like": 0.5, "enjoy": 0.6,
        "happy": 0.7, "glad": 0.6, "pleased": 0.6, "satisfied": 0.6, "cool": 0.5, "nice": 0.5, "sweet": 0.5,
    },
}
# Fixed values.
INTENSIFIERS = {
    "very": 1.5, "really": 1.4, "extremely": 1.8, "super": 1.6, "totally": 1.5, "completely": 1.6, "absolutely": 1.7, "fucking": 1.8, "damn": 1.3, "so": 1.3, "too": 1.2,
    "kind": 0.7, "sort": 0.7, "somewhat": 0.8, "rather": 0.8, "quite": 0.9, "pretty": 0.9, "fairly": 0.8,
}
NEGATIONS = [
    "not", "no", "never", "nothing", "nobody", "nowhere", "neither", "nor", "none", "hardly", "scarcely", "barely", "dont", "don't", "doesnt", "doesn't", "didnt", "didn't",
    "wont", "won't", "wouldnt", "wouldn't", "cant", "can't", "couldnt", "couldn't", "shouldnt", "shouldn't", "isnt", "isn't", "arent", "aren't", "wasnt", "wasn't",
    "werent", "weren't", "hasnt", "hasn't", "havent", "haven't", "hadnt", "hadn't",
]
# Fixed values.
EXPANSIONS = {
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "won't": "will not", "wouldn't": "would not", "can't": "can not", "couldn't": "could not",
    "shouldn't": "should not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "hasn't": "has not", "haven't": "have not",
    "hadn't": "had not", "you're": "you are", "i'm": "i am", "he's": "he is", "she's": "she is", "it's": "it is", "we're": "we are", "they're": "they are",
}
# Pattern over lower-cased text -> score.
PATTERNS = [
    (r"\b(i will|gonna|going to).*(kill|hurt|destroy|beat)", 0.9), (r"\b(you should|you need to).*(die|kill yourself)", 1.0), (r"\byou are.*(stupid|idiot|moron|worthless)", 0.7),
    (r"\bstupid.*(you|person|people)", 0.6), (r"\b(shut up|get lost|go away|leave me alone)", 0.5), (r"\b(fuck off|piss off)", 0.8), (r"\b(haha|lol|lmao).*(loser|fail|stupid)", 0.6), (r"\bwhat a.*(loser|idiot|joke)", 0.7),
]
CONTRACTIONS = {"won't": "will not", "can't": "cannot", "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'d": " would", "'m": " am"}
