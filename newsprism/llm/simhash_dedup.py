"""SimHash near-duplicates: popcount embedding, grid range join, Manhattan bound, exact check.

Fingerprint. Texts are lower-cased in A-Z only and cut into words at space and
\\t-\\r; every run of three words (repeats included) is hashed with XXH64, seed 42.
A bit of the fingerprint is 1 if it is set in more than half the hashes. Texts
under three words are one shingle; a text with no word (or null) has fingerprint 0.

Search. A fingerprint is embedded as 32 counts, the set bits of its 2-bit segments.
The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. The 32 coordinates lie in six groups; a distance of three or less can
touch three groups at most, so two fingerprints within range agree in at least one
choice of three groups. These 20 choices are the grids; the counts in the chosen
groups are the cell. Inside a cell the Manhattan bound over all coordinates comes
first and the exact bit distance decides.

Only distinct fingerprints are searched. A cell with many of them is cut into
blocks and compared block against block in separate groups of bounded size, and
each group returns a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.common import by_place, pick, place, worker_state
from newsprism.llm.components import stars
from newsprism.session import cut_lineage

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
GROUPS = 6
BLOCK = 1024
#: A fingerprint is hot beyond this many rows and beyond one row in this many of all.
HOT_ROWS, HOT_SHARE = 100, 1000


def _fingerprint(text: str | None, shingle_words: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
        hashes = [digest(s, SEED) for s in shingles]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(octets), 1 << 16):
        ones += np.unpackbits(octets[i:i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """64-bit fingerprint (signed long) of each text; never null."""
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_state("simhash_dedup", dict)  # nothing to keep; frees what another operator kept
        for batch in batches:
            yield pd.Series([_fingerprint(t, shingle_words) for t in batch], dtype="int64")
    return of(text)


def embedding(fp: Column) -> Column:
    """The counts of the 32 two-bit segments in unary (0, 01, 11), two bits each in one long.

    In unary the Manhattan distance of two embeddings is the bit count of their xor.
    """
    shifted = F.shiftrightunsigned(fp, 1)
    even = F.lit(0x5555555555555555)
    return F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(even), 1).bitwiseOR(
        fp.bitwiseOR(shifted).bitwiseAND(even))


def _embedding(fp: np.ndarray) -> np.ndarray:
    one, even = np.uint64(1), np.uint64(0x5555555555555555)
    return ((fp & (fp >> one) & even) << one) | ((fp | (fp >> one)) & even)


def _grids(groups: int, max_bits: int) -> list[int]:
    """Masks over the packed counts, one per choice of the groups that must agree."""
    if groups <= max_bits:
        raise ValueError("there must be more groups than differing bits")
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [sum(3 << (2 * c) for c in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(chosen)) for chosen in combinations(masks, groups - max_bits)]


def _forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints (signed 64-bit)."""
    left = values.view(np.uint64)
    counts = _embedding(left)
    edges = []
    while len(left) > 1:
        root, queue = int(left[:1].view(np.int64)[0]), [(left[0], counts[0])]
        left, counts = left[1:], counts[1:]
        while queue and len(left):
            x, c = queue.pop()
            near = np.bitwise_count(counts ^ c) <= max_bits
            if near.any():
                near[near] = np.bitwise_count(left[near] ^ x) <= max_bits
                found, far = left[near], ~near
                edges += [(root, v) for v in found.view(np.int64).tolist()]
                queue += zip(found, counts[near])
                left, counts = left[far], counts[far]
    return edges


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect every two distinct fingerprints ``fp`` with up to ``max_bits`` differing bits.

    ``fingerprints`` holds distinct longs. The edges span each linked set; they
    are at most its size less one for each cell and pair of blocks.
    """
    cells = fingerprints.select("fp", F.posexplode(F.array(
        *[embedding(F.col("fp")).bitwiseAND(F.lit(m)) for m in _grids(groups, max_bits)])).alias("grid", "cell"))
    crowded = (cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
               .withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"))
    member = (cells.join(crowded, ["grid", "cell"])
              .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("grid", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"))
    groups_of = member.groupBy("grid", "cell", "lo", "hi").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")

    @F.pandas_udf("array<struct<a: long, b: long>>")
    def forest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"a": a, "b": b} for a, b in _forest(np.asarray(v, dtype=np.int64), max_bits)]
                             for v in batch])
    return groups_of.select(F.explode(forest("fps")).alias("e")).select("e.a", "e.b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, groups: int = GROUPS) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, root, component_id.

    ``component_id`` is the least doc_id among all rows reachable over links of
    ``max_bits`` or fewer bits, ``root`` the least fingerprint there. Null texts
    count as empty; empty texts share fingerprint 0 and link like any other. Null
    ids never become a component_id (a component of null ids only has null).
    Repeated rows each return a row. ``text_hash`` (XXH64 of the text) tells rows
    apart that share an id. An empty table gives an empty result.
    """
    own = pick(df, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut_lineage(own.select("doc_id", F.xxhash64("text").alias("text_hash"),
                                  fingerprint_column(F.col("text"), shingle_words).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows"))
    tree = stars(links(nodes.select("fp"), max_bits, groups))
    linked = tree.unionByName(tree.select(F.col("root").alias("member"), "root").distinct())
    linked = linked.join(nodes, linked["member"] == nodes["fp"]).select("fp", "root", "least_id")
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(ids, "root").select("fp", "root", "component_id")
    answer = (nodes.join(linked, "fp", "left")
              .select("fp", "rows", F.coalesce("root", "fp").alias("root"),
                      F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id"))
                      .alias("component_id")))
    return _by_fingerprint(rows, answer)


def _by_fingerprint(rows: DataFrame, answer: DataFrame) -> DataFrame:
    """``rows`` with what ``answer`` says of their fingerprints.

    Fingerprints of more than a thousandth of all rows (under a thousand, so small
    enough to broadcast) are answered where their rows lie; the others by a shuffle.
    """
    crowd = max(HOT_ROWS, rows.count() // HOT_SHARE)
    answer = cut_lineage(answer)
    columns = ["doc_id", "text_hash", "fp", "root", "component_id"]
    hot = F.broadcast(answer.where(F.col("rows") > crowd).drop("rows"))
    calm = answer.where(F.col("rows") <= crowd).drop("rows")
    rest = rows.join(hot.select("fp"), "fp", "left_anti").join(calm, "fp")
    return rows.join(hot, "fp").select(columns).unionByName(rest.select(columns))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``df``, all columns as they are: the least id, then the least text hash.

    Null ids come last. Of rows equal in id and text one stays.
    """
    found = near_duplicates(df, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash")
    flat = by_place(df).withColumns({"_id": place(df, id_col).cast("long"),
                                     "_hash": F.xxhash64(place(df, text_col).cast("string"))})
    first = first.select(F.coalesce("doc_id", F.lit(0)).alias("_key"), F.col("doc_id").isNull().alias("_none"),
                         F.col("text_hash").alias("_hash"))
    kept = (flat.withColumns({"_key": F.coalesce("_id", F.lit(0)), "_none": F.col("_id").isNull()})
            .join(first, ["_key", "_none", "_hash"], "left_semi"))
    same = Window.partitionBy("_key", "_none", "_hash").orderBy("_key")
    kept = kept.withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    return kept.select(*[f"_in{i}" for i in range(len(df.columns))]).toDF(*df.columns)
