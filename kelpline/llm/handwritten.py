"""Files that were not written by hand for their corpus.

A linear support-vector classifier decides, on hashed character n-grams of the
body, on those of the comment lines at the top (the header), and on path
components. There are no labels: files that give themselves away (a header of a
generator or of an upstream project, a folder of third-party or built code, a
file name of a tool, a compiler's marks, lines far too long to be typed, or a
body that other repositories hold as well) are the positive examples, files
without any sign the negative ones. Each example with a header is learned twice,
as it is and with the header masked, so that the body must be learned as well
and files are found that bear no sign. All files but prose are learned: they are
dealt by hash to shards of bounded size, a classifier is fitted to each shard, and
the mean of their weights decides. One repository in four is kept for validation;
the thresholds are margins of all its files, in steps of 1 / MARGIN_STEPS, and the
classifier that is used is then fitted to all repositories.

A file is a case if its margin is sure (the wanted precision among the
validation repositories' files, by the shares that the labels have among all
files). If its margin is only likely (nearly all positive examples of the
validation repositories reach it), or its body is empty, an open sign must
confirm it. A sign alone makes no case.

Defined cases: a null or empty content is judged by the path alone; a file that
was indexed several times by its latest content; files of no source row by
their path; null paths are left out; without examples of both kinds nothing can
be learned and nothing comes out, with a warning, as when the validation
repositories lack a kind and the thresholds come from the examples themselves;
an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.plans.joins import salted_join
from kelpline.session import stored

DIM, HEAD, PATHS = 1 << 16, 1 << 15, 1 << 15
WIDTH = 2 * DIM + HEAD + PATHS
TEXT_SCALE, HEAD_SCALE, PATH_SCALE = 20.0, 10.0, 0.5
PAD, HEAD_PAD = b"\0" * 3, b"\0" * 5
_DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))
SHARD, SHARD_CHARS = 10_000, 16 << 20  # files and characters that are expected in a shard
STEPS = 80_000  # steps of a fit, at least one round over its examples
SLICE = 1 << 11  # weights of the shards that are averaged at a time
MARGIN_STEPS = 10_000
PRECISION, RECALL = 0.99, 0.998  # of a sure margin, by the labels; of a likely one, of the positive examples
MARKED, MARKS = 3, 1 << 20  # repositories in which a path component must occur to be learned, and the hashes by which that is counted
LONG = 1 << 14  # n-grams of a text from which on equal ones are counted instead of listed
PIECE = 1 << 20  # bytes, or characters, of texts whose n-grams are computed at a time
COPIES, COPIED_SIZE = 2, 120  # corpora that hold the same body, and its least characters

#: Forms of generators' headers, in several languages.
GENERATOR = r"""(?i)@generated\b|\b(code|file|source)\s+(was\s+)?(auto(matically)?[- ]?)?generated\s+(by|from|with)\b|\bauto-?generated\b\s*(file|code|by|from|>)|\bautomatically generated\b|\bmachine-(written|generated)\b|\b(manual|hand) edits (are|will be)\b|\bchanges will be (lost|overwritten)\b|\b(erzeugt|generiert)\b.{0,60}\büberschrieben\b|\b(produit|généré)e? par\b|\bgenerad[oa] por\b|\bgerad[oa] por\b|\bgenerat[oa] da\b|\bgegenereerd door\b|\bgenererad av\b"""
#: Forms of upstream projects' headers.
UPSTREAM = r"(?i)\bupstream\s*:|\bpart of \S+ v?\d+\.\d|\S+ - release v?\d+\.\d|\S+ v\d+(\.\d+)+ \| |\bcontributors \|"
#: Folders of third-party and of built code, file names of tools.
THIRD = r"(^|/)(_?vendor|node_modules|bower_components|third[_-]?party|3rd[_-]?party|site-packages|godeps|external|extern|deps|pods)/"
BUILT = r"(^|/)(dist|out|build|target|generated|autogen|gen)/"
NAMED = r"(?i)\.min\.\w+$|\.g\.\w+$|outerclass\.java$|\.bundle\.\w+$|[._]pb2?(_grpc)?\.\w+$|\.pb\.\w+$|\.gen(erated)?\.\w+$|_generated\.\w+$|(^|/)zz_generated\.|\.[0-9a-f]{8,}\.\w+$"
#: What compilers leave in a body.
COMPILED = r"""Object\.defineProperty\(exports, ["']__esModule["']|//# sourceMappingURL="""
COMMENT_LINE = r"(?://|#|/\*|\*|--|<!--|;)[^\n]*|[ \t]*"


def header_of(content: Column) -> Column:
    """The comment lines at the top."""
    return F.regexp_extract(F.regexp_replace(content, "\r\n?", "\n"), rf"\A((?:[ \t]*(?:{COMMENT_LINE})\n)*)", 1)


def body_of(content: Column) -> Column:
    """What follows the comment lines at the top, with plain line ends and without blank ends."""
    rest = F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), rf"\A(?:[ \t]*(?:{COMMENT_LINE})\n)*", "")
    return F.trim(F.regexp_replace(rest, r"[ \t]+\n", "\n"))


def files_with_signs(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per file of entries: body, header and the signs it bears."""
    latest = sources.filter("path is not null").groupBy("corpus_id", F.col("path").alias("file_id")).agg(F.max_by("content", F.struct("indexed_at", "hash")).alias("content"), F.max_by("lang", F.struct("indexed_at", "hash")).alias("lang"))
    files = entries.select("corpus_id", "file_id").filter("corpus_id is not null and file_id is not null").distinct().join(latest, ["corpus_id", "file_id"], "left")
    files = files.withColumn("header", F.coalesce(header_of(F.col("content")), F.lit(""))).withColumn("body", F.coalesce(body_of(F.col("content")), F.lit(""))).drop("content")
    prose = F.coalesce(F.col("lang").isin("markdown", "text", "rst"), F.lit(False)) | F.lower("file_id").rlike(r"\.(md|rst|txt|adoc)$")
    in_long = F.aggregate(F.split("body", "\n"), F.lit(0), lambda n, line: n + F.when(F.length(line) > 200, F.length(line)).otherwise(0))
    signs = {
        "generator": F.col("header").rlike(GENERATOR),
        "upstream": F.col("header").rlike(UPSTREAM),
        "third": F.lower("file_id").rlike(THIRD),
        "built": F.lower("file_id").rlike(BUILT),
        "named": F.col("file_id").rlike(NAMED),
        "compiled": F.col("body").rlike(COMPILED),
        "long_lines": in_long * 2 > F.length("body"),
    }
    files = files.withColumn("prose", prose)
    for name, sign in signs.items():
        files = files.withColumn(name, sign & ~F.col("prose"))
    return files.drop("lang")


def copied_bodies(files: DataFrame, corpora: int = COPIES) -> DataFrame:
    """(print): fingerprints of bodies that at least `corpora` corpora hold. Counted with map-side combine."""
    prints = files.filter("print is not null").select("corpus_id", "print")
    return prints.groupBy("print").agg(F.countDistinct("corpus_id").alias("n")).filter(F.col("n") >= corpora).select("print", F.lit(True).alias("copied"))


def gram_columns(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The columns of the 2-grams and then of the hashed 4-grams that start at each byte of a text padded with PAD."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    four = ((two[:-2] * np.uint32(0x9E3779B1)) ^ (two[2:] * np.uint32(0x85EBCA77))) >> 16
    return two[:-2], four + np.uint32(DIM)


def packed_text(texts: list[str], pad: bytes = PAD) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts with digits as zeros, each followed by pad; where each starts and how long it is."""
    raw = [t.encode("utf-8", "replace").translate(_DIGITS) for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    start = np.concatenate([[0], np.cumsum(size + len(pad))[:-1]]) if raw else np.zeros(0, np.int64)
    return pad.join(raw) + pad, start, size


def head_columns(text: bytes) -> np.ndarray:
    """The columns of the hashed 6-grams that start at each byte of a text padded with HEAD_PAD."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    h = np.zeros(max(0, len(b) - 5), np.uint32)
    for i in range(6):
        h = h * np.uint32(0x01000193) + b[i : i + len(h)]
    return ((h * np.uint32(0x9E3779B1)) >> 17) + np.uint32(2 * DIM)


def path_marks(path: str) -> list[int]:
    """Hashes of the folders, and of the extension, start and end of the file name."""
    *folders, name = path.lower().split("/")
    stem, _, ext = name.partition(".")
    marks = [f"d:{f}" for f in folders] + [f"e:{ext}", f"a:{stem[:4]}", f"z:{stem[-5:]}"]
    return [zlib.crc32(m.encode("utf-8", "replace")) for m in marks]


def path_columns(path: str, known: np.ndarray | None = None) -> list[int]:
    """Columns of the marks of a path, only of known ones if these are given by their hash."""
    return [2 * DIM + HEAD + m % PATHS for m in path_marks(path) if known is None or known[m % MARKS]]


class Examples:
    """(columns, values) of each file: the shares of its n-grams and the marks of its path. A column may occur repeatedly.

    A pair is made when it is asked for. What is held is the number of each n-gram
    within its kind, two bytes each, once for a file and its copy without header.
    """

    def __init__(self, body: list[str], header: list[str], path: list[str], known: np.ndarray | None, masked: np.ndarray):
        texts = _grams(body, PAD, gram_columns, (0, DIM), TEXT_SCALE)
        heads = _grams([h.lower() for h in header], HEAD_PAD, lambda text: (head_columns(text),), (2 * DIM,), HEAD_SCALE)
        marks = [(np.array(path_columns(p, known), np.int32), 0, PATH_SCALE) for p in path]
        self.of = np.concatenate([np.arange(len(body)), masked]).astype(np.int64)
        self.parts = [[*texts[k], *heads[k], marks[k]] for k in range(len(body))] + [[*texts[k], marks[k]] for k in masked]

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        parts, end = self.parts[i], 0
        n = sum([len(c) for c, _, _ in parts])
        columns, values = np.empty(n, np.intp), np.empty(n)
        for c, first, value in parts:
            at, end = end, end + len(c)
            columns[at:end] = c
            if first:
                columns[at:end] += first
            values[at:end] = value
        return columns, values


def _grams(texts: list[str], pad: bytes, columns: Callable[[bytes], tuple[np.ndarray, ...]], firsts: tuple[int, ...], scale: float) -> list[list[tuple]]:
    """Of each text and kind of n-grams the columns less the first of the kind, that first, and their values. The n-grams of long texts are counted."""
    text, start, size = packed_text(texts, pad)
    kinds = [np.empty(len(text) - len(pad), np.uint16) for _ in firsts]
    for at in range(0, len(text) - len(pad), PIECE):
        for kind, cols, first in zip(kinds, columns(text[at : at + PIECE + len(pad)]), firsts):
            kind[at : at + PIECE] = cols - np.uint32(first)
    out = []
    for at, n in zip(start.tolist(), size.tolist()):
        share = scale / len(firsts) / max(1, n)
        parts = [(kind[at : at + n], first, float(np.float32(share))) for kind, first in zip(kinds, firsts)]
        if n * len(firsts) > LONG:
            cols, counts = np.unique(np.concatenate([c + np.int32(first) for c, first, _ in parts]), return_counts=True)
            parts = [(cols, 0, (counts * share).astype(np.float32))]
        out.append(parts)
    return out


def features(body: list[str], header: list[str], path: list[str], known: np.ndarray | None = None, masked: np.ndarray = np.zeros(0, np.int64)) -> Examples:
    """The files as examples, and after them copies without header of those that stand at `masked`."""
    return Examples(body, header, path, known, masked)


def _mean_weight(weight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mean weight over the n-grams that start in each text."""
    cuts = np.stack([start, start + size], axis=1).ravel()
    sums = np.where(size > 0, np.add.reduceat(np.append(weight, 0.0), np.minimum(cuts, len(weight)))[::2], 0)
    return sums / np.maximum(size, 1)


def margins(body: list[str], header: list[str], path: list[str], w: np.ndarray) -> np.ndarray:
    """The margin of each file: the mean weights of its n-grams and the weights of its path; nothing is sorted."""
    if not len(body):
        return np.zeros(0)
    text, start, size = packed_text(body)
    two, four = gram_columns(text)
    out = _mean_weight(w[two] + w[four], start, size) * (TEXT_SCALE / 2) + w[-1]
    text, start, size = packed_text([h.lower() for h in header], HEAD_PAD)
    out += _mean_weight(w[head_columns(text)], start, size) * HEAD_SCALE
    marks = [path_columns(p) for p in path]
    return out + np.add.reduceat(w[np.concatenate(marks)], np.cumsum([0, *map(len, marks)])[:-1]) * PATH_SCALE


def train(x: Examples, y: np.ndarray, use: np.ndarray, strength: float = 1e-4, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of a linear support-vector classifier by averaged sub-gradient steps (Pegasos) over the examples that stand at `use`; the last is the bias."""
    rng = np.random.default_rng(seed)
    w, total, scale, t = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), 1.0, 0
    for r in range(rounds):
        for i in use[rng.permutation(len(use))]:
            t += 1
            step = 1 / (strength * (t + 1000))
            cols, values = x[i]
            margin = y[i] * (scale * (w[cols] @ values) + w[-1])
            scale *= 1 - step * strength
            if margin < 1:
                values *= step * y[i]
                values /= scale
                np.add.at(w, cols, values)
                w[-1] += 0.01 * step * strength * y[i]
        if r >= rounds // 2:
            total[:-1] += scale * w[:-1]
            total[-1] += w[-1]
    return total / max(1, rounds - rounds // 2)


def fit(files: DataFrame, flags: DataFrame) -> tuple[np.ndarray, float, float]:
    """(weights, sure margin, likely margin) from all files but prose."""
    files = files.filter("not prose").select("corpus_id", "file_id", "body", "header")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(held=is_held(batch))

    named = flags.filter("not prose").select("corpus_id", "file_id", "sign", "size")
    flags = named.mapInPandas(split, "corpus_id string, file_id string, sign boolean, size int, held boolean")
    kinds = flags.groupBy("held", "sign").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()  # four rows
    if len({r["sign"] for r in kinds}) < 2:
        warnings.warn("no examples of both kinds: nothing can be learned")
        return np.zeros(WIDTH + 1), float("inf"), float("inf")
    apart = len(kinds) == 4
    if not apart:
        warnings.warn("a part of the repositories lacks examples of a kind: the thresholds come from the examples that were learned")
    shards = int(max(1, -(-sum(r["n"] for r in kinds) // SHARD), -(-sum(r["size"] for r in kinds) // SHARD_CHARS)))
    w = shard_weights(files, flags, shards, common_marks(named), apart)
    if not w:
        warnings.warn("no shard holds examples of both kinds: nothing can be learned")
        return np.zeros(WIDTH + 1), float("inf"), float("inf")
    trial = files.sparkSession.sparkContext.broadcast(w.get("trial", w["whole"]))  # WIDTH + 1 numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            judged = batch[is_held(batch)] if apart else batch
            yield judged[["corpus_id", "file_id"]].assign(margin=in_steps(judged, trial.value))

    margin = files.mapInPandas(run, "corpus_id string, file_id string, margin double")
    counts = margin.join(flags.select("corpus_id", "file_id", "sign"), ["corpus_id", "file_id"]).groupBy("margin").agg(F.count_if("sign").alias("right"), F.count(F.lit(1)).alias("n"))
    m = counts.toPandas().sort_values("margin", ascending=False)  # as many rows as margins have steps
    sure = threshold(m["margin"].to_numpy(), m["right"].to_numpy(), m["n"].to_numpy())
    reached = np.cumsum(m["right"].to_numpy()) >= RECALL * m["right"].sum()
    return w["whole"], sure, min(sure, float(m["margin"].to_numpy()[np.argmax(reached)]))


def is_held(files: pd.DataFrame) -> np.ndarray:
    """Which files belong to the repositories kept for validation."""
    return pd.util.hash_array(files["corpus_id"].to_numpy(object)) % 4 == 0


def in_steps(batch: pd.DataFrame, w: np.ndarray) -> np.ndarray:
    """The margins of the files, rounded to steps."""
    chars = np.cumsum([len(b) + len(h) for b, h in zip(batch["body"], batch["header"])], dtype=np.int64)
    group = np.stack([np.arange(len(batch)) // 1000, chars // PIECE])  # of so many files and characters at most, or of one file
    parts = np.split(np.arange(len(batch)), np.flatnonzero(np.diff(group).any(axis=0)) + 1)
    m = [margins(list(p["body"]), list(p["header"]), list(p["file_id"]), w) for p in (batch.iloc[part] for part in parts)]
    return np.rint(np.concatenate([np.zeros(0), *m]) * MARGIN_STEPS) / MARGIN_STEPS + 0.0


def common_marks(flags: DataFrame, least: int = MARKED) -> np.ndarray:
    """Which hashes of path components at least `least` repositories have; the names of the others tell nothing about other repositories."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = {(c, m % MARKS) for c, p in zip(batch["corpus_id"], batch["file_id"]) for m in path_marks(p)}
            yield pd.DataFrame(list(pairs), columns=["corpus_id", "mark"])

    pairs = flags.select("corpus_id", "file_id").mapInPandas(run, "corpus_id string, mark int")
    found = pairs.distinct().groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("mark").toPandas()  # MARKS rows at most
    known = np.zeros(MARKS, bool)
    known[found["mark"].to_numpy(np.int64)] = True
    return known


def shard_weights(files: DataFrame, flags: DataFrame, shards: int, known: np.ndarray, apart: bool) -> dict[str, np.ndarray]:
    """The mean weights over all shards: whole, and if apart also trial, without the repositories that are held.

    Contents move once, to their shard; a shard without examples of both kinds has no weights.
    """
    shard = F.pmod(F.xxhash64("corpus_id", "file_id"), F.lit(shards)).cast("int").alias("shard")
    marks = files.sparkSession.sparkContext.broadcast(known)  # MARKS flags

    def learn(key: tuple, files: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        part = files.merge(flags, on=["corpus_id", "file_id"]).sort_values(["corpus_id", "file_id"])
        masked = np.flatnonzero(part["header"] != "")
        x = features(list(part["body"]), list(part["header"]), list(part["file_id"]), marks.value, masked)
        y, held = np.where(part["sign"], 1.0, -1.0)[x.of], part["held"].to_numpy(bool)[x.of]
        out = []
        for name, use in (("whole", np.arange(len(x))), ("trial", np.flatnonzero(~held)))[: 1 + apart]:
            if len(set(y[use])) == 2:
                w = train(x, y, use, rounds=-(-STEPS // len(use))).astype(np.float32)
                out += [(name, at, key[0], w[at : at + SLICE].tobytes()) for at in range(0, len(w), SLICE)]
        return pd.DataFrame(out, columns=["name", "at", "shard", "w"])

    def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w = np.mean([np.frombuffer(x, np.float32) for x in rows.sort_values("shard")["w"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"name": [key[0]], "at": [key[1]], "w": [w.tobytes()]})

    named = flags.select(shard, F.col("corpus_id").alias("corpus_id"), F.col("file_id").alias("file_id"), "sign", "held")
    each = files.select(shard, "corpus_id", "file_id", "body", "header").groupBy("shard").cogroup(named.groupBy("shard")).applyInPandas(learn, "name string, at int, shard int, w binary")
    means = each.groupBy("name", "at").applyInPandas(mean, "name string, at int, w binary").toPandas().sort_values("at")  # twice WIDTH numbers
    return {name: np.concatenate([np.frombuffer(x) for x in rows["w"]]) for name, rows in means.groupby("name")}


def threshold(margin: np.ndarray, right: np.ndarray, n: np.ndarray, precision: float = PRECISION) -> float:
    """The least margin at and above which the wanted share is right; the largest if there is none. Of each margin, largest first, how many are right and how many there are."""
    good = np.flatnonzero(np.cumsum(right) >= precision * np.cumsum(n))
    return float(margin[good[-1]]) if len(good) else float(margin.max())


def not_by_hand(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(corpus_id, file_id, margin, giveaway, sure) of the files that were not written by hand.

    The contents are shuffled to meet the entries, and stored, and once more to
    be learned; whatever compares files moves only their fingerprints and signs.
    """
    size = F.length("body")
    files = files_with_signs(entries, sources).withColumn("size", size).withColumn("print", F.when((size >= COPIED_SIZE) & ~F.col("prose"), F.xxhash64("body")))
    files = stored(files, "files")
    signs = files.drop("body", "header")
    alone = signs.filter("print is null").withColumn("copied", F.lit(False))
    flags = salted_join(signs.filter("print is not null"), copied_bodies(signs), ["print"], "left", F.struct("corpus_id", "file_id")).withColumn("copied", F.coalesce("copied", F.lit(False)))
    flags = flags.unionByName(alone).withColumn("giveaway", F.expr("generator or upstream or third or built or named or compiled or copied"))
    flags = stored(flags.select("corpus_id", "file_id", "prose", "giveaway", (F.col("giveaway") | F.col("long_lines")).alias("sign"), "size"), "flags")
    w, sure, likely = fit(files, flags)
    shared = files.sparkSession.sparkContext.broadcast(w)  # WIDTH + 1 numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = in_steps(batch, shared.value)
            yield batch[["corpus_id", "file_id"]].assign(margin=m).loc[m >= likely]

    proposed = files.filter("not prose").select("corpus_id", "file_id", "body", "header").mapInPandas(run, "corpus_id string, file_id string, margin double")
    judged = proposed.join(flags, ["corpus_id", "file_id"]).withColumn("sure", (F.col("margin") >= sure) & (F.col("size") > 0))
    return judged.filter(F.col("giveaway") | F.col("sure")).select("corpus_id", "file_id", "margin", "giveaway", "sure")
