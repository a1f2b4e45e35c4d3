"""Personal information in free text: found by kind and replaced by typed placeholders.

Method: information-theoretic sanitisation.  A term t discloses an entity c as far as their
co-occurrence in the corpus says: ``disclosure(t, c) = PMI(t; c) / IC(c)``, which is 1 if t never
occurs without c and 0 if it is independent of it.  The corpus itself is the evidence:

* Forms that a reader recognises without help (e-mail addresses, numbers or house numbers next to a
  cue) are *settled* entities and the seed of the estimates.
* A form that needs help (a number or a street without a cue) takes the disclosure of its term, the
  label word before the number or the street's name, measured over all settled and open forms of its
  kind.  IC(c) is one number for a kind, so bounds are set on the PMI: a form sure by its shape is
  given up where even a generous estimate of the term's PMI is low, one that is not (bare digits) is
  taken where even a cautious estimate is high enough.
* Person names are pairs of terms.  A term discloses a person as a given name if its occurrences
  stand in name-shaped pairs with changing partners; a partner does as a family name if its
  occurrences stand beside such given names.  Pairs of two disclosing terms are names in any case.
  A given name too rare for that counts in a pair that a dotted initial or the words around mark as
  a person, or in a name-shaped pair with a family name disclosed already.  A pair once seen with a
  title is a person wherever it stands, however rare.

Terms above the thresholds are replaced by placeholders; the rest of the text stays as it was.
Estimates use all rows.  Term tables are joined, not shipped, so vocabularies may be of any size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.storage import Stash, spread

KINDS = ("email", "phone", "id_number", "address", "person_name")
#: Least disclosure at which a term gives an open form or a name away.
THRESHOLD = 0.75
#: Lift exp(PMI) of the settled forms among a term's, up to which the term speaks against a form, and from which for one.
AGAINST, IN_FAVOUR = 0.25, 0.3

_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SPELLED = rf"{_DIGIT_WORD}(?:[\s,\-]+{_DIGIT_WORD}){{6,14}}"
_AT = r"(?:\s*[@＠]\s*|\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+)"
_DOT = r"(?:\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+|[.．])"
_LOCAL = r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]*"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
# an address in plain spelling, or one whose at and dot are written out; a bare at needs a written dot
EMAIL = (
    rf"(?:mailto:)?{_LOCAL}[@＠]{_LABEL}(?:[.．]{_LABEL})*[.．]\p{{L}}{{2,}}"
    rf"|(?:mailto:)?{_LOCAL}\s*[(\[{{]\s*at\s*[)\]}}]\s*{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,}}"
    rf"|(?:mailto:)?{_LOCAL}(?:\s+at\s+|[@＠]){_LABEL}(?:\s*[(\[{{]?\s*\bdot\b\s*[)\]}}]?\s*{_LABEL})*\s*[(\[{{]?\s*\bdot\b\s*[)\]}}]?\s*\p{{L}}{{2,}}"
)
_SEP = r"[\s.\-–·/]{0,2}"
PHONE_FORMATTED = (
    rf"(?<![\p{{N}}\p{{L}}.\-$+])(?:\+\s?\d{{1,3}}{_SEP}(?:\(?\d{{2,5}}\)?{_SEP})\d{{2,4}}(?:{_SEP}\d{{2,6}}){{0,3}}"
    rf"|(?:1{_SEP})?\(\d{{3}}\){_SEP}\d{{3}}{_SEP}\d{{4}}"
    rf"|(?:1[\s.\-])?\d{{3}}[\s.\-–]\d{{3}}[\s.\-–]\d{{4}}"
    rf"|0\d{{2,4}}[\s.\-]\d{{3,4}}[\s.\-]\d{{3,4}})(?![\p{{N}}]|[.\-]\d)"
)
PHONE_BARE = r"(?<![\p{N}\p{L}.\-$+_])(?:\d{10,11}|\+\d{10,14})(?![\p{N}\p{L}]|[.\-]\d)"
_ID_CUE = (
    r"(?:social\s+security(?:\s+(?:number|no\.?|num))?|soc(?:ial)?(?:\s+sec)?|ssn|national\s+insurance(?:\s+(?:number|no\.?))?|nino|ni\s+(?:number|no\.?)"
    r"|passport(?:\s*(?:number|no\.?|num|#))?|student\s*(?:id|number|no\.?|card)(?:\s*(?:number|no\.?|#))?"
    r"|driv(?:er|ers|er's|er’s|ers'|ing)\s*licen[cs]e(?:\s*(?:number|no\.?|#))?|licen[cs]e\s*(?:number|no\.?|#)|id\s*(?:card|number|no\.?|#))"
)
_ID_VALUE = rf"(?:[A-Za-z]{{0,3}}[\s\-]?\d[\d\s\-.]{{4,18}}\d\s?[A-Za-z]?(?![\p{{L}}\p{{N}}])|{_SPELLED})"
ID_CUED = rf"(?<![\p{{L}}\p{{N}}]){_ID_CUE}(?:\s+(?:is|was))?[\s:#=]*(?P<v>{_ID_VALUE})"
#: Two letters, six digits in pairs, one letter: a national insurance number by its form alone.
ID_FORM = r"(?<![\p{L}\p{N}])[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d](?![\p{L}\p{N}])"
ID_OPEN = r"(?<![\p{N}\p{L}.\-])\d{3}-\d{2}-\d{4}(?![\p{N}\p{L}]|-\d)"
_PHONE_CUE = r"(?:call|text|txt|cell|phone|mobile|whatsapp|dial|ring|tel|telephone|sms|number|hotline|contact)"
_TYPE = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr(?!\.\s*\p{L})|court|ct|boulevard|blvd|way|close|place|pl|terrace|square|sq|crescent|highway|hwy|parkway|pkwy)"
_NAME = r"(?:(?!(?:to|at|the|in|on|of|for|from|by|near|and|is|with|apt|no)\b)\p{L}[\p{L}'’]+)"
_NO = r"(?:\d{1,5}(?:[\-/]\d{1,4})?[A-Za-z]?)"
_APT = r"(?:,?\s*(?:apt|apartment|unit|suite|ste|flat|#)\.?\s*\p{N}+\p{L}?)?"
ADDRESS = (
    rf"(?<![\p{{N}}\p{{L}}.\-$_])(?P<n1>{_NO})\s+(?P<s1>{_NAME}(?:\s+{_NAME}){{0,2}}?)\s+{_TYPE}\b\.?{_APT}"
    rf"|(?<![\p{{L}}])(?P<s2>{_NAME}(?:\s+{_NAME}){{0,1}}?)\s+{_TYPE}\b\.?,?\s*(?:no|nr|num|number|#)\.?\s*(?P<n2>{_NO})(?!\p{{N}}){_APT}"
    rf"|(?<![\p{{L}}])(?:calle|rue|via|avenida|rua|plaza|paseo)\s+(?P<s3>{_NAME}(?:\s+{_NAME}){{0,1}}?),?\s*(?:n[º°o]\.?\s*)?(?P<n3>{_NO})(?!\p{{N}}){_APT}"
    rf"|(?<![\p{{N}}\p{{L}}.\-$_])(?P<n5>{_NO}),?\s+(?:calle|rue|via|avenida|rua)\s+(?:de\s+la\s+|de\s+|du\s+|des\s+)?(?P<s5>{_NAME})"
    rf"|(?<![\p{{L}}])(?P<s4>(?:{_NAME}\s+)?\p{{L}}+(?:stra(?:ß|ss)e|weg|gasse|platz|str\.))\s*(?:no\.?\s*)?(?P<n4>{_NO})(?!\p{{N}}){_APT}"
)
_ADDRESS_CUE = r"(?:live|lives|living|moved|move|address|house|home|send|sent|ship|party|reside|located|visit|deliver|mail|apt|apartment)"
_WORD = r"\p{L}[\p{L}\p{M}]*(?:['’\-]\p{L}[\p{L}\p{M}]*)*"
_PARTICLES = {"van", "von", "de", "da", "del", "della", "di", "du", "la", "le", "bin", "al", "ter", "der", "den"}
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "mx"}
_RELATION = r"(?:coach|teacher|tutor|professor|friend|bestie|buddy|mate|neighbou?r|cousin|brother|sister|uncle|aunt|boss|manager|classmate|teammate|roommate|colleague|girlfriend|boyfriend|husband|wife|son|daughter|principal|doctor)"
#: What stands right before or after a person's name; a word pair there is a name unless it mostly stands elsewhere.
NAME_BEFORE = rf"\b(?:(?:my|our|your|his|her|their)\s+(?:\p{{L}}+\s+)?{_RELATION}|is\s+that|this\s+is|it['’]?s|shout\s?-?out\s+to|happy\s+birthday|(?:everybody|everyone)\s+knows|named|name\s+is|i\s+am|i['’]m)[\s,:]+$"
#: Words between a label and its number that label nothing themselves.
_LINKING = {"is", "was", "are", "be", "it", "its", "mine", "my", "number", "no", "nr", "here", "the"}
NAME_AFTER = r"\s+(?:from\s+(?:my|our)\s+\p{L}+|you\s+are|you['’]re|ur)\b"


def _fold(word: str) -> str:
    word = word.replace("’", "'").lower()
    return word[:-2] if word.endswith("'s") and len(word) > 3 else word


def _capital(word: str) -> bool:
    return word[0].isupper() and (len(word) == 1 or any(c.islower() for c in word[1:]))


class Finder:
    """Settled and open forms and name pairs of one text; compiled once per Python worker."""

    def __init__(self):
        import regex

        i = regex.IGNORECASE
        self.email = regex.compile(EMAIL, i)
        self.formatted, self.bare, self.spelled = regex.compile(PHONE_FORMATTED), regex.compile(PHONE_BARE), regex.compile(rf"(?<!\p{{L}}){_SPELLED}(?!\p{{L}})", i)
        self.id_cued, self.id_form, self.id_open = regex.compile(ID_CUED, i), regex.compile(ID_FORM), regex.compile(ID_OPEN)
        self.phone_cue, self.address_cue = regex.compile(rf"\b{_PHONE_CUE}\b", i), regex.compile(rf"\b{_ADDRESS_CUE}\b", i)
        self.address, self.word = regex.compile(ADDRESS, i), regex.compile(_WORD)
        self.vague = regex.compile(r"\s(?:way|close|place|drive|square|court)$")  # common words as well
        self.label = regex.compile(r"(\p{L}+)[\s:#.]*\s?$")
        self.dialled = regex.compile(r"1?[2-9]\d\d[2-9]\d{6}|0\d{9,10}")
        self.next = regex.compile(r"\s(\p{L}+)")
        self.digits = regex.compile(r"\p{Nd}")
        self.name_before, self.name_after = regex.compile(NAME_BEFORE, i), regex.compile(NAME_AFTER, i)
        self.maybe_mail, self.number = regex.compile(r"[@＠]|\bat\b", i), regex.compile(rf"\p{{N}}|\b{_DIGIT_WORD}[\s,\-]+{_DIGIT_WORD}\b", i)
        self.dot = regex.compile(r"[.．]|\bdot\b", i)
        self.after = regex.compile(r"^\s*,?\s*(?:apt\b|unit\b|be there|\p{Lu}\p{L}+)", 0)

    def find(self, text: str):
        starts: list[int] = []  # of the spans taken, sorted and apart from each other
        ends: list[int] = []
        settled: list[tuple[str, int, int]] = []
        opened: list[tuple[str, int, int, str, bool]] = []

        def free(a: int, b: int) -> bool:
            i = bisect_right(starts, a)
            return (i == 0 or ends[i - 1] <= a) and (i == len(starts) or b <= starts[i])

        def take(a: int, b: int) -> None:
            i = bisect_right(starts, a)
            starts.insert(i, a), ends.insert(i, b)

        def settle(kind: str, a: int, b: int) -> None:
            take(a, b)
            settled.append((kind, a, b))

        def nearby(a: int, b: int) -> str:
            """A few words on either side, up to the next number or sentence end."""
            return " ".join(text[max(0, a - 60) : a].split()[-3:]) + " | " + " ".join(text[b : b + 60].split()[:2])

        def before(a: int) -> str:
            found = self.label.search(text[max(0, a - 40) : a])
            return _fold(found[1]) if found else ""

        def named_before(a: int) -> str:
            """The label before a number, looking past words that label nothing; '' where there is none."""
            words = self.word.findall(text[max(0, a - 60) : a])
            while words and _fold(words[-1]) in _LINKING:
                words.pop()
            return _fold(words[-1]) if words else ""

        def follows(b: int) -> str:
            """The word right after a number that no label precedes, marked as such."""
            found = self.next.match(text[b : b + 40])
            return ">" + _fold(found[1]) if found else ""

        if self.maybe_mail.search(text) and self.dot.search(text):
            for m in self.email.finditer(text):
                settle("email", *m.span())
        if not self.number.search(text):  # no kind but mail and names is without
            return settled, opened, self.pairs(text, starts, ends)
        for m in self.id_cued.finditer(text):
            value = m["v"]
            number = len(self.digits.findall(value)) or 9
            a, b = m.span("v")
            b -= len(value) - len(value.rstrip(" -."))
            if number >= 5 and free(a, b):
                settle("id_number", a, b)
                if self.id_open.fullmatch(text[a:b]):
                    opened.append(("id_seen", a, b, before(a), True))
        for m in self.id_form.finditer(text):
            if free(*m.span()):
                settle("id_number", *m.span())
        for pattern, plain in ((self.formatted, True), (self.spelled, True), (self.bare, False)):
            for m in pattern.finditer(text):
                a, b = m.span()
                number = len(self.digits.findall(m[0])) or len(m[0].split())
                if not free(a, b) or not 7 <= number <= 15:
                    continue
                take(a, b)
                # a country code or an area code in brackets is as good as a cue
                cued = m[0][0] in "+(" or bool(self.phone_cue.search(nearby(a, b)))
                term = before(a)
                sure = plain or cued or not term and self.dialled.fullmatch(m[0])
                term = term or follows(b)
                opened.append(("phone" if sure else "phone_bare", a, b, term, cued))
        for m in self.address.finditer(text):
            if not free(*m.span()):
                continue
            name = next(m[g] for g in ("s1", "s2", "s3", "s4", "s5") if m[g])
            a, b = m.span()
            cued = bool(self.address_cue.search(" ".join(text[max(0, a - 50) : a].split()[-6:]))) or bool(self.after.search(text[b : b + 30]) and text[b : b + 1] == ",")
            if not cued and name.islower() and self.vague.search(m[0]):
                continue
            take(a, b)
            opened.append(("address", a, b, _fold(name.split()[0] if len(name.split()) == 1 else name), cued))
        for m in self.id_open.finditer(text):
            if free(*m.span()):
                take(*m.span())
                opened.append(("id_number", *m.span(), named_before(m.start()), False))
        return settled, opened, self.pairs(text, starts, ends)

    def pairs(self, text: str, starts: list[int], ends: list[int]):
        """(left, right, start, end, comma, shaped, strong, cue, titled) for every word and the next name-like one.

        ``right`` is '' where none follows.  An initial or particles may stand between; single letters
        and particles start no pair.  ``cue``: a title, a dotted initial or the words around say it is a person.
        """
        words = list(self.word.finditer(text))
        if starts:
            kept, at = [], 0
            for m in words:
                while at < len(ends) and ends[at] <= m.start():
                    at += 1
                if at == len(ends) or m.end() <= starts[at]:
                    kept.append(m)
            words = kept
        out = []
        for i, m in enumerate(words):
            one = m[0]
            if len(one) < 2 or one.lower() in _PARTICLES or one.lower() in _TITLES:
                continue
            j, initial, dotted = i + 1, False, False
            right, comma, end = "", False, m.end()
            while j < len(words):
                gap = text[end : words[j].start()]
                word = words[j][0]
                bare = gap.strip()
                if bare == "," and j == i + 1 and gap[-1:].isspace():
                    comma = True
                elif bare and not (initial and bare == "."):
                    break
                dotted = dotted or initial and bare == "." and text[end - 1].isupper()
                if not comma and len(word) == 1 and not initial:
                    initial, end, j = True, words[j].end(), j + 1
                    continue
                if not comma and word.lower() in _PARTICLES:
                    initial = True if initial and bare == "." else initial
                    end, j = words[j].end(), j + 1
                    continue
                if comma and len(word) < 2 or word.lower() in _TITLES:
                    break
                right, end = word, words[j].end()
                break
            titled = i > 0 and words[i - 1][0].lower() in _TITLES and text[words[i - 1].end() : m.start()].strip() in ("", ".")
            start = words[i - 1].start() if titled else m.start()
            shaped = bool(right) and _capital(one) and _capital(right)
            end = end if right else m.end()
            cue = shaped and (titled or dotted or bool(self.name_before.search(text[max(0, start - 60) : start]) or self.name_after.match(text[end : end + 40])))
            out.append((_fold(one), _fold(right), start, end, comma, shaped, shaped and (titled or initial or comma), cue, shaped and titled))
        return out


_finder: list[Finder] = []


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if not _finder:
        _finder.append(Finder())
    find = _finder[0].find
    names = ("l", "r", "start", "end", "comma", "shaped", "strong", "cue", "titled")
    for frame in frames:
        found = [find(t) for t in frame.pop("text")]
        yield frame.assign(
            settled=[[{"kind": k, "start": a, "end": b} for k, a, b in s] for s, _, _ in found],
            opened=[[{"kind": k, "start": a, "end": b, "term": t, "cued": c} for k, a, b, t, c in o] for _, o, _ in found],
            pairs=[[dict(zip(names, p)) for p in ps] for _, _, ps in found],
        )


def disclosure(n_term, n_both, n_entity, n_all):
    """PMI(t; c) / IC(c) from counts, at most 1; 0 where t and c never meet."""
    p = n_entity / n_all
    return F.when(n_both > 0, F.log(n_both / n_term / p) / -F.log(p)).otherwise(F.lit(0.0))


def find_personal(df: DataFrame, record: str, text: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows: record, text; items: record, text, kind, start, end) over all of ``df``.

    Repeated rows count once.  Null records and null or empty texts hold no items.  Start and end are
    character positions in the text, from 0.
    """
    rows, items = search(df, record, text, threshold)
    return rows.select("record", "text"), items.join(rows, ["record", "digest"]).select("record", "text", "kind", "start", "end")


def search(df: DataFrame, record: str, text: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows: record, text, digest; items: record, digest, kind, start, end), as ``find_personal``.

    Texts are read once; from then on the digest of a text stands for it.
    """
    spark = df.sparkSession
    stash = Stash(spark, "personal")
    plain = df.select(F.col(record).cast("string").alias("record"), F.col(text).cast("string").alias("text")).where("record IS NOT NULL AND text <> ''")
    rows = plain.distinct().withColumn("digest", F.sha2("text", 256))
    schema = (
        "record string, digest string, settled array<struct<kind:string,start:int,end:int>>, opened array<struct<kind:string,start:int,end:int,term:string,cued:boolean>>, "
        "pairs array<struct<l:string,r:string,start:int,end:int,comma:boolean,shaped:boolean,strong:boolean,cue:boolean,titled:boolean>>"
    )
    scanned = stash.put(spread(spark, plain, "record", "text").distinct().select("record", F.sha2("text", 256).alias("digest"), "text").mapInPandas(_scan, schema))
    settled = scanned.select("record", "digest", F.explode("settled").alias("e")).select("record", "digest", "e.kind", "e.start", "e.end")

    opened = scanned.select("record", "digest", F.explode("opened").alias("e")).select("record", "digest", "e.*")
    opened = opened.withColumn("form", F.when(F.col("kind") == "phone_bare", "phone").when(F.col("kind") == "id_seen", "id_number").otherwise(F.col("kind")))
    terms = opened.groupBy("form", "term").agg(F.count("*").alias("n"), F.count_if("cued").alias("both"))
    totals = terms.groupBy("form").agg(F.nullif(F.sum("both") / F.sum("n"), F.lit(0.0)).alias("base"))  # null where no form is settled
    terms = terms.join(F.broadcast(totals), "form")  # one row for each form
    # lift of the settled forms among the term's; one form more is taken to be as all are, or not settled
    generous, cautious = (F.col("both") + F.col("base")) / (F.col("n") + 1) / F.col("base"), F.col("both") / (F.col("n") + 1) / F.col("base")
    verdicts = terms.select("form", "term", (F.col("term") != "").alias("named"), generous.alias("generous"), cautious.alias("cautious"))
    judged = opened.where("kind <> 'id_seen'").join(verdicts, ["form", "term"])
    against = F.col("named") & F.coalesce(F.col("generous") <= AGAINST + 1e-9, F.lit(False))
    favour = F.col("named") & F.coalesce(F.col("cautious") >= IN_FAVOUR, F.lit(False))
    # an SSN-like number takes no label or one of social security numbers; bare digits take one that names phones
    accept = F.when(F.col("cued"), True).when(F.col("kind") == "phone_bare", favour).when(F.col("kind") == "id_number", ~F.col("named") | favour).otherwise(~against)
    items = judged.where(accept).select("record", "digest", F.col("form").alias("kind"), "start", "end")

    pairs = scanned.select("record", "digest", F.explode("pairs").alias("e")).select("record", "digest", "e.*")
    given, family = F.when(F.col("comma"), F.col("r")).otherwise(F.col("l")), F.when(F.col("comma"), F.col("l")).otherwise(F.col("r"))
    counts = stash.put(pairs.groupBy(F.col("l").alias("term")).agg(F.count("*").alias("n")))
    slots = pairs.where("shaped").groupBy(given.alias("term"), family.alias("partner")).agg(F.count("*").alias("n"), F.count_if("strong").alias("strong"), F.count_if("cue").alias("cue"), F.count_if("titled").alias("titled"))
    couples = stash.put(slots)
    slots = couples
    slots = slots.groupBy("term").agg(F.count("*").alias("partners"), F.sum("n").alias("both"), F.sum("strong").alias("strong"), F.sum("cue").alias("cue"))
    base = counts.agg(F.sum("n").alias("all")).join(pairs.agg((2 * F.count_if("shaped")).alias("entity")), how="cross")  # one row
    measured = slots.join(counts, "term").join(F.broadcast(base), how="cross")
    known = disclosure(F.col("n"), F.col("both"), F.col("entity") + 1, F.col("all") + 2)
    measured = stash.put(measured.where((known >= threshold) & (F.col("both") >= 0.3 * F.col("n"))))
    givens = stash.put(measured.where((F.col("partners") >= 3) | (F.col("strong") >= 1) & (F.col("partners") >= 2) | (F.col("strong") >= 2)).select("term"))
    sided = pairs.where("r <> ''").select("record", "digest", "start", "end", "shaped", given.alias("given"), family.alias("family"))
    named = stash.put(sided.join(givens.withColumnRenamed("term", "given"), "given", "left_semi"))
    beside = named.groupBy(F.col("family").alias("term")).agg(F.count("*").alias("both")).join(counts, "term", "left")
    families = beside.where(F.col("both") >= 0.5 * F.coalesce("n", "both")).join(givens, "term", "left_anti").select(F.col("term").alias("family"))
    families = stash.put(families)
    people = named.join(families, "family", "left_semi").select("record", "digest", F.lit("person_name").alias("kind"), "start", "end")

    # a rare given name has no partners to count: its pair counts by the words around, or by a family name known already
    rare = measured.join(givens, "term", "left_anti").select(F.col("term").alias("given"), "both", "cue")
    pairs_of = couples.select(F.col("term").alias("given"), F.col("partner").alias("family"), F.col("n").alias("pair"), F.col("cue").alias("pair_cue")).join(rare, "given")
    beside = couples.groupBy(F.col("partner").alias("family")).agg(F.sum("n").alias("beside")).join(counts.select(F.col("term").alias("family"), F.col("n").alias("alone")), "family", "left")
    likely = beside.where(F.col("beside") >= 0.5 * F.coalesce("alone", "beside")).select("family")
    told = pairs_of.where((F.col("pair_cue") > 0) & (F.col("cue") >= 0.5 * F.col("both"))).join(likely, "family", "left_semi").select("given", "family")
    kin = families.unionByName(told.select("family")).distinct()
    shared = pairs_of.join(kin, "family", "left_semi").select("given", "family")
    titled = couples.where("titled > 0").select(F.col("term").alias("given"), F.col("partner").alias("family"))
    known_pairs = stash.put(told.unionByName(shared).unionByName(titled).distinct())
    others = sided.join(known_pairs, ["given", "family"], "left_semi").select("record", "digest", F.lit("person_name").alias("kind"), "start", "end")
    return rows, settled.unionByName(items).unionByName(people).unionByName(others)


def redact(df: DataFrame, record: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``record, text, kinds``: every distinct row with its items replaced by ``<KIND>``.

    Text outside the items is left as it was; a text without items comes out unchanged, an empty or
    null text as it is.  Overlapping items of one place give the placeholder of the first.
    """
    _, items = search(df, record, text, threshold)
    every = df.select(F.col(record).cast("string").alias("record"), F.col(text).cast("string").alias("text")).where("record IS NOT NULL").distinct()
    spans = items.groupBy("record", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("spans"))

    @F.pandas_udf("string")
    def replace(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t, spans_):
            if spans_ is None or len(spans_) == 0:
                return t
            out, at = [], 0
            for s in spans_:
                if s["start"] < at:
                    continue
                out += [t[at : s["start"]], f"<{s['kind'].upper()}>"]
                at = s["end"]
            return "".join([*out, t[at:]])

        return pd.Series([one(t, f) for t, f in zip(texts, found)])

    joined = every.withColumn("digest", F.sha2("text", 256)).join(spans, ["record", "digest"], "left")
    kinds = F.coalesce(F.array_sort(F.array_distinct(F.col("spans.kind"))), F.array().cast("array<string>"))
    return joined.select(F.col("record").alias(record), replace("text", "spans").alias(text), kinds.alias("kinds"))
