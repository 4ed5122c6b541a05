"""Languages of documents and of their mixed-language segments.

A text is cut into sentences of running text; code, headers, paths and lines of
mostly other signs are left out. A sentence is a normalised TF-IDF vector of
hashed character n-grams, with document frequencies counted over all sentences
of the corpus. The centroids are fitted to a bounded sample of sentences with delivered
labels and of code lines: sentences nearer to the mean of another language are
taken for wrongly labelled and left out, and the rest of each language is
clustered by spherical k-means into several centroids. A sentence gets the language of the nearest centroid by cosine, with
the lead over the best other language as confidence, and none if it is too far
from all or nearest to code. Sentences of one language in a row are a segment.

Defined cases: null, empty, blank, very short or symbol-only texts have no
language; null ids are left out; labels of any notation are compared by the language they name; a null
or unknown label names none; repeated documents come out each; an empty table or
one without labels gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.session import stored

BITS, GRAMS = 13, (2, 3, 4)
DIM = 1 << BITS
SAMPLE_DOCS, SAMPLE_SENTENCES = 120, 300  # bounds of the labelled sample, per language
CENTROIDS = 4  # per language
FLOOR, MIN_LETTERS = 0.08, 120

#: The names of the languages in other notations.
NAMES = {
    "en": ["en", "eng", "english"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "sv": ["sv", "swe", "swedish", "svenska"],
    "ru": ["ru", "rus", "russian", "русский"],
    "ja": ["ja", "jpn", "japanese", "日本語"],
}
CODE = "code"

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_FRONT = re.compile(r"\A---\r?\n.*?\n---\r?\n", re.S)
_PREFIX = re.compile(r"^\s*(?:[>*+\-|]\s+|\[\d{1,2}:\d{2}(?::\d{2})?\]\s*(?:[^\W\d_][\w .'’-]{0,40}:)?\s*|\d{1,3}[.)]\s+)+")
_HEADER = re.compile(r"^\s*(?:#{1,6}\s|=|[A-Za-z][\w-]{0,24}:\s*\S.*<|(?:From|To|Cc|Bcc|Subject|Date|Reply-To|Message-ID|id|kind|confidence|title|updated|scope|source)\s*:|\S*/\S*$|\[\[.*\]\]\s*$|\d{4}-\d{2}-\d{2}\b)")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?://|/\*|\*/|import |from \S+ import|def |class |return\b|package |func |let |const |var |if \(|for \()|=>|\w\(.*\)|\w\.\w+\(|[\w\]]\s*[:+\-*/|&]?=\s*\S")
_CODE_START = re.compile(r"\s*(?://|/\*|\*/|import |from \S+ import|def |class |return\b|package |func |let |const |var |if \(|for \()")
_END = re.compile(r"(?<=[.!?…])[\s\"'”»)]+(?=\S)|(?<=[。！？])\s*")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def language_of_label(label: Column) -> Column:
    """The two-letter code that a label names, or null."""
    name = F.element_at(F.split(F.lower(F.trim(label)), r"[-_ (]"), 1)
    codes = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)])
    return F.try_element_at(codes, F.coalesce(name, F.lit("")))


def letters(s: str) -> int:
    return sum(map(str.isalpha, s))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence) of the running text, in order."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    body = _FENCE.sub(blank, _FRONT.sub(blank, text))
    out, at = [], 0
    for line in body.splitlines(keepends=True):
        start, at = at, at + len(line)
        if _HEADER.match(line):
            continue
        skip = m.end() if (m := _PREFIX.match(line)) else 0
        rest = line[skip:].rstrip()
        if not rest or _CODE_START.match(rest) or (any(c in rest for c in ";{}=(") and _CODE_LINE.search(rest)):
            continue
        here = 0
        for cut in [*_END.finditer(rest), None]:
            stop, nxt = (cut.start(), cut.end()) if cut else (len(rest), len(rest))
            s = rest[here:stop]
            n = letters(s)
            if n >= 12 and n + s.count(" ") >= 0.75 * len(s):
                out.append((start + skip + here, start + skip + stop, s))
            here = nxt
    return out


def code_lines(text: str) -> list[str]:
    """Lines of fenced code with at least 12 letters."""
    return [line for block in _FENCE.findall(text) for line in block.splitlines()[1:] if letters(line) >= 12]


def hashed(parts: list[str]) -> np.ndarray:
    """row * DIM + column of each hashed n-gram of the parts."""
    clean = [" " + _NOT_LETTER.sub(" ", p.lower()).strip() + " " for p in parts]
    code = np.frombuffer("".join(clean).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(clean), dtype=np.int32), [len(c) for c in clean])
    keys, h = [], np.zeros(len(code), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n > len(code):
            break
        h = h[: len(code) - n + 1] * np.uint32(1000003) + code[n - 1 :]
        if n in GRAMS:
            mixed = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
            keys.append((row[: len(h)] * np.int32(DIM) + mixed)[row[: len(h)] == row[n - 1 :]])
    return np.concatenate(keys) if keys else np.zeros(0, np.int32)


def ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of the hashed n-grams of each part, sorted by row."""
    key, count = np.unique(hashed(parts), return_counts=True)
    return key // DIM, key % DIM, count


def tfidf(parts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) with rows of length 1."""
    row, col, count = ngrams(parts)
    w = (1 + np.log(count)) * idf[col]
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(parts)))
    return row, col, (w / np.maximum(norm[row], 1e-12)).astype(np.float32)


def cosines(parts: list[str], idf: np.ndarray, centroids: np.ndarray, block: int = 128) -> np.ndarray:
    """len(parts) x number of centroids; a block of parts is one dense matrix at a time."""
    out = np.zeros((len(parts), centroids.shape[0]), np.float32)
    by_col = np.ascontiguousarray(centroids.T)
    x = np.zeros((block, DIM), np.float32)
    for at in range(0, len(parts), block):
        row, col, w = tfidf(parts[at : at + block], idf)
        x[row, col] = w
        n = min(block, len(parts) - at)
        out[at : at + n] = x[:n] @ by_col
        x[row, col] = 0
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the place of each row, seeded by distance (k-means++)."""
    rng = np.random.default_rng(seed)
    centre = [x[rng.integers(len(x))]]
    best = x @ centre[0]
    for _ in range(1, min(k, len(x))):
        far = np.maximum(1 - best, 0) ** 2
        centre.append(x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))])
        best = np.maximum(best, x @ centre[-1])
    c = np.stack(centre)
    for _ in range(rounds):
        place = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, place, x)
        n = np.linalg.norm(sums, axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-12)[:, None], c)
    return c, (x @ c.T).argmax(axis=1)


def agreeing(x: np.ndarray, labels: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Which rows are nearest to the mean of their own label, where the means are of such rows only.

    Means start from all rows of a label, most of which are rightly labelled;
    wrongly labelled rows lie nearer to the mean of their true language.
    """
    names = np.unique(labels)
    own = np.searchsorted(names, labels)
    good = np.ones(len(x), bool)
    for _ in range(rounds):
        means = np.stack([x[good & (own == i)].mean(axis=0) if (good & (own == i)).any() else np.zeros(x.shape[1], x.dtype) for i in range(len(names))])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
        now = (x @ means.T).argmax(axis=1) == own
        if (now == good).all():
            break
        good = now
    return good


def cut(documents: DataFrame) -> DataFrame:
    """(doc_id, start, end, sentence), arrays: the sentences of each document that has any, cut once and stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                got = [(i, *zip(*found)) for i, t in zip(part["doc_id"], part["text"]) if (found := sentences(t))]
                yield pd.DataFrame(got, columns=["doc_id", "start", "end", "sentence"])

    rows = documents.filter("text is not null and doc_id is not null").select("doc_id", "text")
    return stored(rows.mapInPandas(run, "doc_id bigint, start array<int>, end array<int>, sentence array<string>"), "sentences")


def document_frequencies(parts: DataFrame) -> np.ndarray:
    """Smoothed idf of every hashed n-gram over all sentences of all documents; DIM numbers come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(DIM, np.int64), 0
        for batch in batches:
            own = [s for d in batch["sentence"] for s in d]
            for at in range(0, len(own), 256):
                has = np.zeros(256 * DIM, bool)
                has[hashed(own[at : at + 256])] = True
                total += has.reshape(256, DIM).sum(axis=0)
            rows += len(own)
        yield pd.DataFrame({"col": np.arange(-1, DIM), "n": np.concatenate([[rows], total])})

    counted = parts.select("sentence").mapInPandas(run, "col int, n bigint").groupBy("col").agg(F.sum("n").alias("n")).toPandas()  # DIM + 1 rows
    n = np.zeros(DIM + 1)
    n[counted["col"].to_numpy(np.int64) + 1] = counted["n"]
    return np.log((1 + n[0]) / (1 + n[1:])) + 1


def labelled_sample(documents: DataFrame) -> pd.DataFrame:
    """(lang, sentence): at most SAMPLE_SENTENCES of each language and of code, from at most SAMPLE_DOCS documents each, chosen by hash."""
    order = F.xxhash64("doc_id")
    docs = documents.filter("text is not null").select("doc_id", "text", language_of_label(F.col("lang")).alias("lang")).filter("lang is not null")
    docs = docs.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))).filter(F.col("r") <= SAMPLE_DOCS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(lang, s) for lang, t in zip(batch["lang"], batch["text"]) for _, _, s in sentences(t)]
            rows += [(CODE, s) for t in batch["text"] for s in code_lines(t)]
            yield pd.DataFrame(rows, columns=["lang", "sentence"])

    found = docs.select("lang", "text").mapInPandas(run, "lang string, sentence string").distinct()
    w = Window.partitionBy("lang").orderBy(F.xxhash64("sentence"), "sentence")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SAMPLE_SENTENCES).drop("r").toPandas().sort_values(["lang", "sentence"], ignore_index=True)


def fit(documents: DataFrame, parts: DataFrame) -> dict:
    """idf, centroids and their languages, from the documents and their sentences."""
    idf = document_frequencies(parts)
    sample = labelled_sample(documents)
    if not len(sample):
        return {"idf": idf, "centroids": np.zeros((0, DIM), np.float32), "langs": []}
    x = np.zeros((len(sample), DIM), np.float32)
    row, col, w = tfidf(list(sample["sentence"]), idf)
    x[row, col] = w
    labels = sample["lang"].to_numpy()
    trusted = agreeing(x, labels)
    centroids, langs = [], []
    for lang in np.unique(labels[trusted]):
        c, place = spherical_kmeans(x[trusted & (labels == lang)], CENTROIDS)
        centroids += [c[i] for i in range(len(c)) if (place == i).any()]
        langs += [str(lang)] * (len(centroids) - len(langs))
    return {"idf": idf, "centroids": np.stack(centroids).astype(np.float32), "langs": langs}


def classify(parts: list[str], model: dict) -> tuple[list[str | None], np.ndarray]:
    """The language and confidence of each part; None where all centroids are too far or code is nearest."""
    names = sorted(set(model["langs"]))
    if not names or not parts:
        return [None] * len(parts), np.zeros(len(parts))
    s = cosines(parts, model["idf"], model["centroids"])
    of = np.array([names.index(x) for x in model["langs"]])
    best = np.stack([s[:, of == i].max(axis=1) for i in range(len(names))], axis=1)
    top = best.argmax(axis=1)
    first = best[np.arange(len(parts)), top]
    rest = best.copy()
    rest[np.arange(len(parts)), top] = 0
    lead = first - rest.max(axis=1)
    lang = [names[i] if f >= FLOOR and names[i] != CODE else None for i, f in zip(top, first)]
    return lang, np.where(first > 0, lead / np.maximum(first, 1e-9), 0)


def smoothed(langs: list[str | None], lead: np.ndarray) -> list[str | None]:
    """An unsure sentence between two of one language takes that language; an unsure one at an edge its neighbour's. One look each way."""
    sure = [lang if lang and x >= 0.25 else None for lang, x in zip(langs, lead)]
    before, after = [None] * len(sure), [None] * len(sure)
    for seen, order in ((before, range(len(sure))), (after, range(len(sure) - 1, -1, -1))):
        last = None
        for i in order:
            seen[i] = last
            last = sure[i] or last
    return [lang if lang is None or s or not (b == a or b is None or a is None) else b or a or lang for lang, s, b, a in zip(langs, sure, before, after)]


def segments(parts: DataFrame, model: dict) -> DataFrame:
    """(doc_id, start, end, lang, letters, confidence): runs of sentences of one language, from the sentences of each document."""
    shared = parts.sparkSession.sparkContext.broadcast(model)  # DIM numbers and at most 44 centroids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                langs, lead = classify([s for d in part["sentence"] for s in d], shared.value)
                rows, i = [], 0
                for doc_id, starts, ends, d in zip(part["doc_id"], part["start"].map(list), part["end"].map(list), part["sentence"]):
                    own = smoothed(langs[i : i + len(d)], lead[i : i + len(d)])
                    open_ = None
                    for start, end, sentence, lang, sure in zip(starts, ends, d, own, lead[i : i + len(d)]):
                        if lang is None:
                            continue
                        size = letters(sentence)
                        if open_ and open_[3] == lang:
                            open_[2], open_[4], open_[5] = end, open_[4] + size, open_[5] + size * float(sure)
                        else:
                            open_ = [doc_id, start, end, lang, size, size * float(sure)]
                            rows.append(open_)
                    i += len(d)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "lang", "letters", "confidence"])
                out["confidence"] = (out["confidence"] / out["letters"].clip(lower=1)).astype(float).round(4)
                yield out

    return parts.mapInPandas(run, "doc_id bigint, start int, end int, lang string, letters int, confidence double")


def document_languages(parts: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(doc_id, lang, letters, confidence): the languages with at least min_letters letters of running text."""
    n = F.sum("letters")
    return parts.groupBy("doc_id", "lang").agg(n.alias("letters"), F.round(F.sum(F.col("confidence") * F.col("letters")) / n, 4).alias("confidence")).filter(F.col("letters") >= min_letters)


def mislabelled(documents: DataFrame, languages: DataFrame) -> DataFrame:
    """The languages of documents whose label does not name exactly their only language."""
    label = documents.select("doc_id", language_of_label(F.col("lang")).alias("label"))
    count = languages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    joined = languages.join(label, "doc_id").join(count, "doc_id")
    return joined.filter((F.col("n") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang")))


def labelled(documents: DataFrame) -> DataFrame:
    """The segments of all documents by a model that is fitted to them."""
    parts = cut(documents)
    return stored(segments(parts, fit(documents, parts)), "segments")
