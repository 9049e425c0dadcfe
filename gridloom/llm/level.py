"""The reading level of each document's prose (problem 10).

Words' syllables come from hyphenation patterns (`hyphenation`). Each sentence gets the grades of several classic
formulas as they were published for its language, of which the median counts; the document's grade is the median over its
words of the grades of their sentences, so a few sentences of another level don't move it. The grades at which levels
begin are fitted on documents labelled by hand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.hyphenation import syllables
from gridloom.llm.prose import passages, text_cells

#: Words of prose a document needs for a level.
MIN_WORDS = 40
#: Grades from which levels 2 and 3 begin, by language, where no labels are given or those given leave a choice: fitted on the labels of sf0.1.
BOUNDS = {"en": (5.3, 21.4), "de": (3.8, 16.2), "es": (5.4, 14.6)}
#: Labelled documents the bounds are fitted on, at most (those with the least hash of their key).
MAX_LABELS = 4_000
#: Words whose counts a process remembers.
REMEMBERED = 200_000
_ROWS = 512

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’\-]\p{L}[\p{L}\p{M}]*)*")
_END = regex.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")

# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": frozenset("the of and to is are this that with our every each my we they you it its for by on at from was were which before after".split()),
    "de": frozenset("der die das und ist sind den dem des ein eine einen einer mit für von zu im auf wir sie ich nicht nach vor wenn jede jeden unsere".split()),
    "es": frozenset("el la los las y es son un una de del con por para en que nosotros ella se su sus al cuando pero antes este esta cada nuestro".split()),
}

# Flesch's scores with the school grades he gave them, and Anderson's long words a sentence with theirs.
FLESCH = [(0, 17.0), (30, 16.0), (50, 12.0), (60, 9.0), (70, 7.5), (80, 6.5), (90, 5.5), (100, 4.5)]
RIX = [(0.0, 1), (0.2, 2), (0.5, 3), (0.8, 4), (1.3, 5), (1.8, 6), (2.4, 7), (3.0, 8), (3.7, 9), (4.5, 10), (5.3, 11), (6.2, 12), (7.2, 13)]


def _on_scale(x: float, scale: list[tuple[float, float]]) -> float:
    """The grade on a scale between whose steps it changes evenly, and beyond whose ends as between the last two."""
    i = min(max(sum(x >= at for at, _ in scale) - 1, 0), len(scale) - 2)
    (a, g), (b, h) = scale[i], scale[i + 1]
    return g + (x - a) * (h - g) / (b - a)


def grades(words: int, letters: int, sylls: int, poly: int, long: int, mono: int, lang: str) -> list[float]:
    """School grades of one sentence: its words, letters, syllables, words of three or more syllables, of more than six letters, of one syllable.

    English: Flesch-Kincaid, Gunning's fog, SMOG, ARI, Coleman-Liau. German: the first and third Vienna formula, Amstad's
    reading ease, Anderson's RIX. Spanish: the reading eases of Fernández Huerta and of Szigriszt, Crawford's, RIX.
    """
    per = sylls / words
    if lang == "de":
        hard, lengthy, short = 100 * poly / words, 100 * long / words, 100 * mono / words
        vienna = 0.1935 * hard + 0.1672 * words + 0.1297 * lengthy - 0.0327 * short - 0.875
        third = 0.2963 * hard + 0.1905 * words - 1.1144
        return [vienna, third, _on_scale(180 - words - 58.5 * per, FLESCH), _on_scale(long, RIX)]
    if lang == "es":
        huerta, szigriszt = 206.84 - 60 * per - 1.02 * words, 206.835 - 62.3 * per - words
        crawford = -20.5 / words + 4.9 * per - 3.407
        return [_on_scale(huerta, FLESCH), _on_scale(szigriszt, FLESCH), crawford, _on_scale(long, RIX)]
    kincaid = 0.39 * words + 11.8 * per - 15.59
    fog = 0.4 * (words + 100 * poly / words)
    smog = 1.043 * math.sqrt(30 * poly) + 3.1291
    ari = 4.71 * letters / words + 0.5 * words - 21.43
    coleman = 5.88 * letters / words - 29.6 / words - 15.8
    return [kincaid, fog, smog, ari, coleman]


def language(words: list[str], told: str | None) -> str:
    """The language whose function words are most frequent; without any, the one told (first two letters), else English."""
    lower = [w.lower() for w in words]
    hits = {k: sum(w in f for w in lower) for k, f in FUNCTION_WORDS.items()}
    best = max(hits, key=lambda k: hits[k])
    if hits[best]:
        return best
    told = (told or "").strip().lower()[:2]
    return told if told in BOUNDS else "en"


_counts: dict[tuple[str, str], tuple[int, int]] = {}


def _count(word: str, lang: str) -> tuple[int, int]:
    got = _counts.get((lang, word))
    if got is None:
        if len(_counts) >= REMEMBERED:
            _counts.clear()
        got = _counts[lang, word] = (len(word), syllables(word, lang))
    return got


def grade(text: str | None, nb_format: str | None = None, told: str | None = None) -> tuple[int, str, float] | None:
    """Words of prose, their language and the grade of a document's text; None without prose."""
    if not text:
        return None
    sentences: list[list[str]] = []
    for cell in text_cells(text, nb_format):
        for passage in passages(cell):
            for s in _END.split(passage):
                words = WORD.findall(s)
                if words:
                    sentences.append(words)
    total = sum(map(len, sentences))
    if not total:
        return None
    lang = language([w for s in sentences for w in s], told)
    marks = []
    for words in sentences:
        letters = sylls = poly = long = mono = 0
        for w in words:
            a, b = _count(w, lang)
            letters += a
            sylls += b
            poly += b > 2
            long += a > 6
            mono += b == 1
        marks.append((median(grades(len(words), letters, sylls, poly, long, mono, lang)), len(words)))
    marks.sort()
    so_far = 0
    for g, n in marks:
        so_far += n
        if 2 * so_far >= total:
            return total, lang, g
    return total, lang, marks[-1][0]


def fit_bounds(graded: list[tuple[str, float, int]]) -> dict[str, tuple[float, float]]:
    """Bounds from (language, grade, level) of labelled documents.

    A bound is where most labels agree with the side their grade is on. Between neighbouring grades at which as many
    do, the place nearest to the one in BOUNDS counts, so few labels move a bound no farther than they tell.
    """
    out = {}
    for lang, default in BOUNDS.items():
        mine = sorted((g, no) for of, g, no in graded if of == lang)
        bounds = []
        for i, usual in enumerate(default):
            # Agreeing labels if the bound lies below the first grade, between two, ... above the last one.
            agree = [sum(no >= i + 2 for _, no in mine)]
            for _, no in mine:
                agree.append(agree[-1] + (1 if no < i + 2 else -1))
            edges = [-math.inf, *(g for g, _ in mine), math.inf]
            best = [(edges[k], edges[k + 1]) for k, n in enumerate(agree) if n == max(agree) and edges[k] < edges[k + 1]]
            nearest = min(((lo + hi) / 2 if math.isfinite(lo + hi) and not lo < usual <= hi else min(max(usual, lo), hi) for lo, hi in best), key=lambda x: abs(x - usual), default=usual)
            bounds.append(nearest)
        out[lang] = (bounds[0], max(bounds))
    return out


def level(g: float, lang: str, bounds: dict[str, tuple[float, float]] = BOUNDS) -> int:
    """1 everyday, 2 ordinary technical, 3 learned."""
    low, high = bounds[lang]
    return 1 if g < low else 2 if g < high else 3


def document_grades(documents: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """key, words, language, grade of each document with `min_words` or more words of prose (see `reading_levels`)."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                s = b.slice(i, _ROWS)
                keys, rows = [], []
                for k, *rest in zip(*(c.to_pylist() for c in s.columns)):
                    got = grade(*rest)
                    if got and got[0] >= min_words:
                        keys.append(k)
                        rows.append(got)
                n, lang, g = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(keys, s.column(0).type), pa.array(n, pa.int32()), pa.array(lang, pa.string()), pa.array(g, pa.float64())], ["key", "words", "language", "grade"])

    out = documents.select(key, *[F.make_valid_utf8(c).alias(c) for c in ("text", "nb_format", "lang")]).mapInArrow(run, f"key {kind}, words int, language string, grade double")
    return out.withColumnRenamed("key", key)


def labelled_grades(documents: DataFrame, labels: DataFrame, key: str = "doc_id", most: int = MAX_LABELS) -> list[tuple[str, float, int]]:
    """language, grade and level_no of labelled documents: of `most` keys at most, each label of a document."""
    usable = labels.where("level_no BETWEEN 1 AND 3").dropna(subset=[key]).select(key, "level_no")
    some = usable.select(key).distinct().orderBy(F.xxhash64(key), key).limit(most)
    rows = usable.join(F.broadcast(some), key, "left_semi").collect()
    graded = document_grades(documents.join(F.broadcast(some), key, "left_semi"), key).dropDuplicates([key])
    found = {r[key]: (r["language"], r["grade"]) for r in graded.collect()}
    return [(*found[r[key]], r["level_no"]) for r in rows if r[key] in found]


def reading_levels(documents: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """key, words, language, grade, level_no of each document with `min_words` or more words of prose.

    Needs the columns text, lang and nb_format; formats and languages that are null or unknown are told from the text.
    Null, empty and blank texts, and those without enough prose, give no row; repeated rows one each. `labels` (key,
    level_no) fit the bounds of the levels; without any, BOUNDS hold. Whole texts are read, and nothing is shuffled.
    """
    bounds = fit_bounds(labelled_grades(documents, labels, key)) if labels is not None else BOUNDS
    no = F.lit(None).cast("int")
    for lang, (low, high) in bounds.items():
        no = F.when(F.col("language") == lang, F.when(F.col("grade") < low, 1).when(F.col("grade") < high, 2).otherwise(3)).otherwise(no)
    return document_grades(documents, key, min_words).withColumn("level_no", no)
