"""Scores for abusive, hateful and sexual text.

Method: gradient-boosted trees over dense features (lexicon densities, second-person proximity,
capitals, punctuation and obfuscation rates), with isotonic calibration.  Before the lexicons are
looked up, disguises are undone: look-alike letters, letters as digits or signs, full-width forms,
invisible characters, repeated letters, letters set apart, masked letters, split words.  Harmless uses
and reported speech are taken out of the counts, and are features of their own.

Beside the hand-written lexicons stands one that is learned: the log odds of word n-grams among the
examples.  For the examples themselves it comes from the folds they are not in, so that the trees see
evidence of the kind and strength that new texts will have.

The model is fitted on reviewers' examples, at most ``MAX_SAMPLES`` of them, and sent to the tasks;
features and scores are made in one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import html
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import abuse_lexicon as L
from skeinwork.llm.boosting import Calibrated

#: Largest number of labelled examples the classifier is fitted on (by least sample id).
MAX_SAMPLES = 20_000
THRESHOLD = 0.5
#: Tokens a worker remembers the plain form of.
REMEMBERED = 50_000
#: Longest learned n-gram in words, and the examples it must occur in.
NGRAM, SUPPORT = 3, 2
PHRASES = ("threats", "wishes", "demeaning", "hate", "soliciting")
FEATURES = (
    "log_chars", "log_words", "insults", "insult_density", "adjectives", "pairs", "sexual", "threats", "wishes", "demeaning", "hate", "soliciting",
    "foreign", "table_words", "second_person", "mentions", "closeness", "directed", "net", "net_density", "harmless", "reporting", "capitals",
    "exclamations", "punctuation", "obfuscated", "disguised_hits", "learned_sum", "learned_most", "learned_least",
)


def _squeeze(word: str) -> str:
    out = word[:1]
    for c in word[1:]:
        if c != out[-1]:
            out += c
    return out


class Features:
    """Dense features of a text; ``table`` holds further words and phrases of abuse."""

    def __init__(self, table: list[str]):
        import regex

        fold = {w.strip().lower() for w in table if w and w.strip()}
        self.nouns, self.adjectives, self.sexual = set(L.INSULT_NOUNS), set(L.INSULT_ADJECTIVES), set(L.SEXUAL)
        self.table = {w for w in fold if " " not in w}
        self.foreign = set(L.FOREIGN_WORDS)
        self.kind: dict[str, int] = {}
        for bit, listed in enumerate((self.nouns, self.adjectives, self.sexual, self.table, self.foreign)):
            for w in listed:
                self.kind[w] = self.kind.get(w, 0) | 1 << bit
        # words of the phrases take part when disguises are undone, though they are no abuse by themselves
        phrases = L.THREATS + L.WISHES + L.DEMEANING + L.HATE + L.SOLICITING
        spoken = {w for p in phrases for w in regex.findall(r"[a-z]{4,}", regex.sub(r"\\[a-zA-Z]", " ", p))}
        words = self.nouns | self.adjectives | self.sexual | self.table | spoken | {"kys", "like", "you", "foreigners"}
        self.known = words
        self.squeezed = {}
        for w in sorted(words):
            self.squeezed.setdefault(_squeeze(w), w)
        first = self.nouns | self.adjectives | self.sexual | set(L.HARM_WORDS)
        self.masked: dict[tuple[str, str, int], str] = {}
        for w in sorted(words, key=lambda w: (w in spoken and w not in first, w)):
            if len(w) >= 3:
                self.masked.setdefault((w[0], w[-1], len(w)), w)
        any_of = lambda patterns: regex.compile("|".join(f"(?:{p})" for p in patterns))
        self.patterns = {k: any_of(p) for k, p in (("threats", L.THREATS), ("wishes", L.WISHES), ("demeaning", L.DEMEANING), ("hate", L.HATE), ("soliciting", L.SOLICITING), ("harmless", L.HARMLESS), ("reporting", L.REPORTING))}
        self.phrases = any_of([regex.escape(p) for p in L.FOREIGN_PHRASES])
        self.table_phrases = [w for w in fold if " " in w]
        self.mention, self.token = regex.compile(r"[@＠][\p{L}\p{N}_.]*[\p{L}\p{N}_]"), regex.compile(r"\S+")
        self.core = regex.compile(r"^([^\p{L}\p{N}*@$|!€£]*)(.*?)([^\p{L}\p{N}*$]*)$", regex.S)
        self.word = regex.compile(r"[\p{L}\p{M}\p{N}*]+(?:['’\-][\p{L}\p{M}]+)*")
        self.latin, self.letter = regex.compile(r"[a-z]"), regex.compile(r"\p{L}")
        self.spaced = regex.compile(r"(?<![\p{L}\p{N}])[\p{L}\p{N}@$!]([\s.\-_~])(?:[\p{L}\p{N}@$!]\1)+[\p{L}\p{N}](?![\p{L}\p{N}])")
        self.leet = str.maketrans(L.LEET)
        self.leet_l = str.maketrans(L.LEET | {"1": "l"})
        self.alike = str.maketrans(L.LOOKALIKES)
        self.inner = regex.compile(r"[._\-~*+,'’`^|\\/]")
        self.unseen, self.letters, self.uppers, self.marks, self.digits = (regex.compile(p) for p in (r"[\p{Cf}--\N{ZERO WIDTH JOINER}]", r"\p{L}", r"\p{Lu}", r"[^\p{L}\p{N}\s]", r"\p{N}"))
        self.format = regex.compile(r"\p{Cf}")
        self.cores: dict[str, tuple[str, str, int, int]] = {}
        self.learned: dict[str, float] = {}

    def plain(self, token: str) -> tuple[str, bool]:
        """The token without disguise, and whether it wore one that hid a listed word."""
        low = token.lower()
        if low in self.known:
            return low, False
        has_latin = bool(self.latin.search(low))
        if has_latin and not low.isascii():
            turned = token.translate(self.alike).lower()
            if turned.isascii():
                low = turned
        forms = [low]
        stripped = self.inner.sub("", low)
        if "*" in low[1:]:
            body = low.strip(".,!?")
            hit = self.masked.get((body[0], body[-1], len(body))) if len(body) >= 3 and "*" not in (body[0], body[-1]) else None
            if hit and all(a in ("*", b) for a, b in zip(body, hit)):
                return hit, True
        if stripped != low:
            forms.append(stripped)
        for form in tuple(forms):
            if any(c in L.LEET for c in form) and (has_latin or len(form) >= 4 and not form.isdigit()):
                forms += [form.translate(self.leet), form.translate(self.leet_l)]
        for form in forms:
            if form in self.known:
                return form, form != token.lower()
        for form in forms:
            hit = self.squeezed.get(_squeeze(form))
            if hit and len(hit) >= 3 and len(form) >= len(hit):
                return hit, True
        for form in forms[1:]:
            if form.isalpha() and has_latin and any(c.isdigit() for c in low):
                return form, False
        out = low[:1]
        for i, c in enumerate(low[1:], 1):  # runs of three and more letters become one
            if not (c == low[i - 1] and (i + 1 < len(low) and low[i + 1] == c or i > 1 and low[i - 2] == c)):
                out += c
        return out, False

    def normal(self, text: str) -> tuple[str, list[str], int, int, int]:
        """(normalised text, its words, mentions, disguised hits, odd tokens)."""
        if "&" in text:
            text = html.unescape(html.unescape(text))
        hidden = 0
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
            hidden = len(self.unseen.findall(text))
            text = self.format.sub("", text).replace("’", "'")
        text, mentions = self.mention.subn(" @ ", text)
        hits, odd = 0, min(hidden, 3)

        def together(m) -> str:
            def tighten(part: str) -> tuple[str, bool]:
                tight = "".join(c for c in part if c not in " .-_*~\t\n")
                return tight, any(self.squeezed.get(_squeeze(v)) for v in self._variants(tight.lower()))

            head, (tight, listed) = "", tighten(m[0])
            if not listed and m[0][:2].lower() in ("a ", "i ", "u "):  # a word of its own
                head, (tight, listed) = m[0][:2], tighten(m[0][2:])
            return head + tight if listed or len(tight) >= 4 and sum(map(str.isalpha, tight)) >= 3 else m[0]

        joined = self.spaced.sub(together, text)
        if joined != text:
            odd += 1
            hits += 1
        tokens = []
        for raw in joined.split():
            if raw == "@":
                tokens.append("@")
                continue
            word, hit, strange = self._token(raw)
            hits += hit
            odd += strange
            tokens.append(word)
        # a word split in two by a blank
        out: list[str] = []
        for t in tokens:
            if out and t.isalpha() and out[-1].isalpha() and t not in self.known and out[-1] not in ("a", "i", "u") and out[-1] + t in self.known:
                out[-1] += t
                hits, odd = hits + 1, odd + 1
            else:
                out.append(t)
        return " ".join(out), out, mentions, hits, odd

    def _token(self, raw: str) -> tuple[str, int, int]:
        """(the token without disguise, whether it wore one, whether it looks odd), remembered for a while."""
        found = self.cores.get(raw)
        if found is None:
            before, core, after = self.core.match(raw).groups()
            word, hit = self.plain(core) if core else ("", False)
            found = before + word + after, int(hit), int(hit or bool(self.digits.search(core)) and bool(self.letter.search(core)))
            if len(self.cores) >= REMEMBERED:
                self.cores.clear()
            if len(raw) <= 64:
                self.cores[raw] = found
        return found

    def _variants(self, word: str) -> list[str]:
        return [word, word.translate(self.leet), word.translate(self.leet_l), word.translate(self.alike)]

    def row(self, text: str | None) -> list[float]:
        if not text or not text.strip():
            return [0.0] * len(FEATURES)
        plain, _, mentions, hits, odd = self.normal(text)
        capitals = len(self.uppers.findall(text)) / max(1, len(self.letters.findall(text)))
        words = [m[0].strip("'") for m in self.word.finditer(plain.replace("@", " youat "))]
        kept, harmless, reporting = words, 0, 0
        phrase = {k: len(self.patterns[k].findall(plain)) for k in PHRASES}
        others = self.others(plain)
        if any(phrase.values()) or others or any(w in self.kind for w in words):  # there is something to take back
            net, harmless = self.patterns["harmless"].subn(" _ ", plain)
            net, reporting = self.patterns["reporting"].subn(" _ ", net)
            if harmless or reporting:
                kept = [m[0].strip("'") for m in self.word.finditer(net.replace("@", " youat "))]
                phrase, others = {k: len(self.patterns[k].findall(net)) for k in PHRASES}, self.others(net)
        nouns = adjectives = sexual = foreign = in_table = pairs = 0
        person, bad, last = [], [], 0
        for i, w in enumerate(kept):
            kind = self.kind.get(w, 0)
            if kind:
                nouns, adjectives, sexual, in_table, foreign = nouns + (kind & 1), adjectives + (kind >> 1 & 1), sexual + (kind >> 2 & 1), in_table + (kind >> 3 & 1), foreign + (kind >> 4 & 1)
                pairs += bool(last & 2 and kind & 3)
                bad.append(i)
            elif w == "youat" or w in L.SECOND_PERSON:
                person.append(i)
            last = kind
        if others:
            in_table += sum(p in net for p in self.table_phrases)
            foreign += len(self.phrases.findall(net))
        closest = nearest(person, bad)
        directed = sum(bisect_right(person, i + 4) > bisect_left(person, i - 4) for i in bad)
        total = nouns + adjectives + sexual + foreign + sum(phrase.values())
        n = max(1, len(words))
        marks = len(self.marks.findall(text))
        odds = [self.learned[g] for g in self.ngrams(kept) if g in self.learned] if self.learned else []
        return [
            np.log1p(len(text)), np.log1p(len(words)), nouns + adjectives, (nouns + adjectives) / n, adjectives, pairs, sexual,
            phrase["threats"], phrase["wishes"], phrase["demeaning"], phrase["hate"], phrase["soliciting"], foreign, in_table, len(person), mentions,
            0.0 if closest is None else 1 / (1 + closest), directed, total, total / n, harmless, reporting, capitals,
            text.count("!") + text.count("！"), marks / max(1, len(text)), odd / n, hits,
            sum(odds) / (1 + len(odds)) ** 0.5, max(odds, default=0.0), min(odds, default=0.0),
        ]

    def others(self, text: str) -> bool:
        """Whether phrases of the table or of other languages occur."""
        return any(p in text for p in self.table_phrases) or self.phrases.search(text) is not None

    def ngrams(self, words: list[str]) -> set[str]:
        """Distinct n-grams of a text's words; a mention is one word whoever is named."""
        return {" ".join(words[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(words) - n + 1)}

    def words(self, text: str | None) -> list[str]:
        """The words that count: without disguises, harmless uses and reported speech."""
        plain = self.normal(text)[0] if text and text.strip() else ""
        for kind in ("harmless", "reporting"):
            plain = self.patterns[kind].sub(" _ ", plain)
        return [m[0].strip("'") for m in self.word.finditer(plain.replace("@", " youat "))]

    def log_odds(self, texts: list[str | None], y: np.ndarray) -> dict[str, float]:
        """Smoothed log odds of abuse for each n-gram that ``SUPPORT`` examples hold."""
        bad, good = Counter(), Counter()
        for text, label in zip(texts, y):
            (bad if label else good).update(self.ngrams(self.words(text)))
        n_bad, n_good = y.sum() + 2, len(y) - y.sum() + 2
        return {g: float(np.log((bad[g] + 1) / n_bad) - np.log((good[g] + 1) / n_good)) for g in bad.keys() | good.keys() if bad[g] + good[g] >= SUPPORT}

    def matrix(self, texts) -> np.ndarray:
        return np.array([self.row(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def nearest(one: list[int], other: list[int]) -> int | None:
    """Least distance between two sorted lists of positions; None where one is empty."""
    best = None
    i = j = 0
    while i < len(one) and j < len(other):
        gap = abs(one[i] - other[j])
        best = gap if best is None or gap < best else best
        if one[i] < other[j]:
            i += 1
        else:
            j += 1
    return best


_ready: dict[int, Features] = {}


@dataclass
class Scorer:
    """A calibrated model with the n-gram evidence it was fitted with."""

    model: Calibrated
    learned: dict[str, float]

    @classmethod
    def fit(cls, texts: list[str | None], y: np.ndarray, table: list[str], folds: int = 5) -> Scorer:
        features = Features(table)
        x = features.matrix(texts)
        fold = np.random.default_rng(5).permutation(len(y)) % folds
        for k in range(folds):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            features.learned = features.log_odds([texts[i] for i in rest], y[rest])
            x[own] = features.matrix([texts[i] for i in own]) if len(own) else x[own]
        return cls(Calibrated.fit(x, y), features.log_odds(texts, y))

    def predict(self, texts: list[str | None], table: list[str]) -> np.ndarray:
        key = hash((tuple(table), len(self.learned)))
        if key not in _ready:
            _ready.clear()
            _ready[key] = Features(table)
        features = _ready[key]
        features.learned = self.learned
        return self.model.predict(features.matrix(texts))


def fit(samples: DataFrame, sample_id: str, text: str, verdict: str, table: list[str], harmless: str = "none", max_samples: int = MAX_SAMPLES) -> Scorer:
    """The calibrated classifier from at most ``max_samples`` labelled texts, those of least id."""
    rows = samples.select(F.col(sample_id).alias("i"), F.col(text).alias("t"), F.col(verdict).alias("v")).where("t IS NOT NULL AND v IS NOT NULL")
    taken = rows.orderBy("i", "t").limit(max_samples).collect()
    y = np.array([float(r["v"].strip().lower() != harmless) for r in taken])
    return Scorer.fit([r["t"] for r in taken], y, table)


def score(df: DataFrame, record: str, text: str, model: Scorer, table: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``record, *keep, score`` for every row of ``df``; null and blank texts have the score 0.

    ``table`` is the bounded list of further words the model was fitted with.  Rows are neither
    dropped nor merged; columns of ``df`` that are not named are not read.
    """
    picked = df.select(F.col(record).alias("_record"), F.col(text).cast("string").alias("_text"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame.pop("_text")
            blank = np.array([not isinstance(t, str) or not t.strip() for t in texts], dtype=bool)
            wanted, place = np.unique(texts[~blank].to_numpy(dtype=str).astype(object), return_inverse=True) if (~blank).any() else ([], [])
            p = np.zeros(len(texts))
            if len(wanted):
                p[~blank] = model.predict(list(wanted), table)[place]
            yield frame.assign(score=p)

    schema = ", ".join(f"{n} {t}" for n, t in kinds.items() if n != "_text") + ", score double"
    out = picked.mapInPandas(run, schema)
    return out.select(F.col("_record").alias(record), *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], "score")


def word_table(df: DataFrame, word: str, most: int = 100_000) -> list[str]:
    """The distinct cleaned words of a small list; refuses a list longer than ``most``."""
    rows = df.select(F.lower(F.trim(word)).alias("w")).where("w <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words: not a word list")
    return sorted(r["w"] for r in rows)


def rates(scored: DataFrame, record: str, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """``source, records, flagged, rate``: distinct records for each source, and those at or above the
    threshold.  A record in several rows counts once, by its highest score.  Null sources are one group."""
    once = scored.where(F.col(record).isNotNull()).groupBy(source, record).agg(F.max("score").alias("score"))
    out = once.groupBy(source).agg(F.count("*").alias("records"), F.count_if(F.col("score") >= threshold).alias("flagged"))
    return out.withColumn("rate", F.col("flagged") / F.col("records"))
