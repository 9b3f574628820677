"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits. If two differ in at most 3, then one of their halves differs in at most 1 bit (pigeonhole), so
each half is searched on its own with threshold 1. The anchors of a half are a covering code of its 32 bits: the
perfect Hamming code on 31 of them (2 ** 26 code words, every word within 1 of exactly one) times the free bit. A
fingerprint lives at its own anchor, within the covering radius, and is copied to every anchor within radius plus
threshold: the 16 code words within 2 of its 31 bits with its own free bit, and its own code word with the free bit
flipped, 17 copies a half. If a half of u differs from that of v in at most one bit, u is copied to the anchor where v
lives; so comparing, per anchor, the copies with the residents finds every link and nothing needs all pairs. A half has
2 ** 27 anchors. From 2 ** 36 distinct fingerprints on, halves give way to triples of five blocks: three differences leave
three of five blocks with at most one, and a triple has 2 ** 33 anchors and more. So the residents that a copy meets stay few at any size.
Distinct fingerprints are compared, not documents: copies of a text are one fingerprint.

Groups are the connected components of the links; each is named by its smallest id.

``similar_texts`` is for a filtering stage, which takes five-word shingles and a similarity of 0.8. Fingerprints of such pairs lie
up to some fifteen bits apart, so anchors give the first candidates and an exact prefix-filtered join of the shingle sets the
rest; bitmaps of the sets rule out most candidates that only share a passage, and what is left is verified on the whole sets.

Edge cases: a null text has no words; texts without words have fingerprint 0 and are linked like any other; a
null id never names a group unless all ids of it are null; repeated rows have one fingerprint and one
group; an empty table gives an empty result; columns other than the id and the text are ignored; ids may have any type. In
similar_texts() ids that are no whole numbers count by their hashes, and rows that share an id are one node, as similar as the most
similar of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_names, joined_with, looked_up, shuffle_width, written
from .components import components

#: Bits of a byte, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
CODE_BITS, CODE_WAYS = 31, 16
#: Fixed value: nodes without an id are numbered from here.
_UNNAMED = 1 << 62

#: A search is a choice of blocks (first bit, bits) of the fingerprint, read as one word of 31 bits and more.
Search = tuple[tuple[int, int], ...]
HALVES: tuple[Search, ...] = (((0, 32),), ((32, 32),))
_FIFTHS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TRIPLES: tuple[Search, ...] = tuple(combinations(_FIFTHS, 3))
#: Distinct fingerprints from which on triples are searched.
MANY = 1 << 36


def shingles(text: str | None, size: int) -> list[bytes]:
    """Runs of size words, A-Z lower-cased, space-joined; the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return [joined[a : b - 1] for a, b in zip(starts, starts[min(size, len(words)) :], strict=False)]


def shingle_hashes(runs: list[bytes], seed: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in runs], "<u8")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority vote, bit by bit, of the XXH64 hashes of a text's word shingles, repeats included."""
    return majority(shingle_hashes(shingles(text, shingle), seed))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        votes = np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        places = by_byte.astype(np.int32) + np.arange(0, 2048, 256, dtype=np.int32)
        votes = (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long) for every row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


# --- anchors ---------------------------------------------------------------------------------------------


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the values of each of a word's four bytes (bit i counts i + 1); by syndrome, what turns a word into the code
    words within 2 of it, the nearest first. Syndrome 0 is a code word itself, with no other within 2."""
    of_byte = np.zeros((4, 256), np.int64)
    for byte in range(4):
        for bit in range(8):
            if 8 * byte + bit < CODE_BITS:
                of_byte[byte, (np.arange(256) >> bit & 1).astype(bool)] ^= 8 * byte + bit + 1
    ways = np.zeros((CODE_BITS + 1, CODE_WAYS), np.int64)
    for s in range(1, CODE_BITS + 1):
        pairs = [1 << i - 1 | 1 << (i ^ s) - 1 for i in range(1, CODE_BITS + 1) if i < i ^ s]
        ways[s] = [1 << s - 1, *pairs]
    return of_byte, ways


def anchors(fps: np.ndarray, searches: tuple[Search, ...] = HALVES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint's index, anchor, is its own) for all searches of each fingerprint."""
    of_byte, ways = code_tables()
    index, keys, own = [], [], []
    every = np.arange(len(fps))
    bits = fps.view(np.uint64)
    for number, blocks in enumerate(searches):
        word, width = np.zeros(len(fps), np.int64), 0
        for first, n in blocks:
            word |= (bits >> np.uint64(first) & np.uint64((1 << n) - 1)).astype(np.int64) << width
            width += n
        code, free = word & (1 << CODE_BITS) - 1, word >> CODE_BITS
        rest = of_byte[0][code & 255] ^ of_byte[1][code >> 8 & 255] ^ of_byte[2][code >> 16 & 255] ^ of_byte[3][code >> 24]
        key = number << 48 | free << CODE_BITS
        home = key | (code ^ ways[rest, 0])
        # the nearest code word for all, the others where the word is none itself
        off = np.flatnonzero(rest)
        index += [every, np.repeat(off, CODE_WAYS - 1)]
        keys += [home, ((key | code)[off, None] ^ ways[rest[off], 1:]).ravel()]
        own += [np.ones(len(fps), bool), np.zeros(len(off) * (CODE_WAYS - 1), bool)]
        for bit in range(CODE_BITS, width):
            index += [every]
            keys += [home ^ (1 << bit)]
            own += [np.zeros(len(fps), bool)]
    return np.concatenate(index), np.concatenate(keys), np.concatenate(own)


def _meetings(distinct: DataFrame, searches: tuple[Search, ...], threshold: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """a < b (fingerprints), a_x and b_x (of each carried bigint column x), at least once for each pair that differs in
    1 to threshold bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("halves and triples of blocks cover thresholds up to 3")
    names = ["anchor", "fp", *carry]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def placed(own_only: bool, end: str, anchor: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                index, keys, own = anchors(columns[0], searches)
                if own_only:
                    index, keys = index[own], keys[own]
                yield pa.record_batch([pa.array(keys), *[pa.array(c[index]) for c in columns]], schema=schema)

        made = distinct.select("fp", *carry).mapInArrow(run, ", ".join(f"{n} long" for n in names))
        return made.toDF(anchor, end, *[f"{end}_{c}" for c in carry])

    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    residents, visitors = placed(True, "a", "anchor"), placed(False, "b", "at")
    # Spark takes both for as small as the file of fingerprints, which the copies are many times of: neither may be broadcast
    return residents.join(visitors.hint("merge"), (F.col("anchor") == F.col("at")) & near).drop("anchor", "at")


def fingerprint_links(distinct: DataFrame, threshold: int = 3, searches: tuple[Search, ...] = HALVES) -> DataFrame:
    """a < b: all pairs of the distinct fingerprints (column fp) that differ in 1 to threshold bits."""
    return _meetings(distinct, searches, threshold).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 3, seed: int = 42) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id for every row of docs."""
    found = written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("times")), "simhash-distinct")
    n, rows = distinct.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    often = max(1000, rows // 1000)
    roots = components(fingerprint_links(distinct, threshold, TRIPLES if n > MANY else HALVES))
    members = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "times", "root")
    smallest = members.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("nodes"))
    linked = looked_up(members.filter("root IS NOT NULL"), smallest, ["root"], "nodes", often).select("fp", "times", F.coalesce("least", "first").alias("component_id"))
    alone = members.filter("root IS NULL").select("fp", "times", F.col("first").alias("component_id"))
    return looked_up(found, linked.unionByName(alone), ["fp"], "times", often, shuffled=True).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- similar texts ---------------------------------------------------------------------------------------

#: Rows that an owner of tokens holds at once, about, and rows of one token that are dealt by a salt beyond that.
OWNED, SALTED = 2_000_000, 250_000
_CUT = np.uint64(24)  # tokens are told apart by 40 bits: what they share by chance is only one more candidate


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A row's node: its id, by its hash if it is no whole number, or for a row without one a number beyond ids that its text
    decides."""
    unnamed = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).bitwiseAND(F.lit(_UNNAMED - 1)) + F.lit(_UNNAMED)
    name = F.col(id_col)
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    return F.coalesce(name.cast("long") if whole else F.when(name.isNotNull(), F.xxhash64(name).bitwiseAND(F.lit(_UNNAMED - 1))), unnamed)


@dataclass(frozen=True)
class Order:
    """What is known of tokens before they are read: those that a sample holds more than once, sorted, with their rank (the rarest first)
    and the number of salts of each; and the number of owners. It decides where work goes, never what is found."""

    known: np.ndarray
    rank: np.ndarray
    salts: np.ndarray
    owners: int

    def prefix(self, found: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, salts) of the first tokens of a set, as many that two sets of the similarity share one of them."""
        if not len(found):
            return np.zeros(1, np.uint64), np.ones(1, np.int64)  # all texts without words are one set
        rank, salts = np.zeros(len(found), np.int64), np.ones(len(found), np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            met = self.known[at] == found
            rank, salts = np.where(met, self.rank[at], 0), np.where(met, self.salts[at], 1)
        order = np.lexsort((found, rank))[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]
        return found[order], salts[order]


def token_order(texts: DataFrame, shingle: int, similarity: float, one_of: int = 16, most: int = 100_000) -> Order:
    """The order of tokens, from one text (node, text) in one_of; most: tokens that are ranked at most."""
    schema = pa.schema([("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(np.unique(shingle_hashes(shingles(text, shingle), 42)).view(np.int64))], schema=schema)

    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(one_of)) == 0).select("text").mapInArrow(run, "hash long")
    counted = written(sample.groupBy("hash").agg(F.count("*").alias("n")), "simhash-sample")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counted.filter("n > 1").orderBy(F.desc("n"), "hash").limit(most).collect()
    known, times = np.array([r["hash"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.int64)
    order = np.argsort(known)
    owners = max(2 * shuffle_width(texts.sparkSession), int(total * one_of * (1 - similarity)) // OWNED)
    return Order(known[order], (len(known) - np.arange(len(known)))[order], -(-times * one_of // SALTED)[order], owners)


def _planes(column: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress well."""
    return column.view(np.uint8).reshape(len(column), -1).T.tobytes()


def pack_rows(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> bytes:
    """Rows of one owner, sorted by token."""
    import zstandard

    body = b"".join([_planes(tokens), _planes(nodes), _planes(sizes), _planes(places)])
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_rows(blob: bytes) -> list[np.ndarray]:
    import zstandard

    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, found = len(body) // 24, 0, []
    for kind in (np.uint64, np.int64, np.int32, np.int32):
        width = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return found


def parity_bits(found: np.ndarray) -> bytes:
    """A set's bitmap, some two bits an element: a bit is 1 if an odd number of elements falls on it. Where two bitmaps differ,
    the sets do, so the bits that differ are never more than the elements that do."""
    width = max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """How many elements two sets differ in at least, by their bitmaps. The longer one is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(_BITS[x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)].sum())


def signatures(texts: DataFrame, shingle: int, similarity: float, order: Order) -> DataFrame:
    """For each text (node, text) its fingerprint, the size of its set and the set's bitmap (node, fp, size, bits), and for each owner the rows (token, node, size of the set, place in the
    order) of the prefixes of a batch of texts, packed (owner, rows). One pass cuts the shingles for both."""
    bounded_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(order)  # of bounded size
    schema = pa.schema([("owner", pa.int32()), ("rows", pa.binary()), ("node", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            prints, sizes, bits, cut = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(shingles(text, shingle), 42)
                found = np.unique(hashes)
                prints.append(majority(hashes))
                sizes.append(len(found))
                bits.append(parity_bits(found))
                cut.append(known.prefix(found, similarity))
            empty = pa.nulls(len(nodes))
            prints = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.record_batch([empty.cast(pa.int32()), empty.cast(pa.binary()), pa.array(nodes), prints, pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], schema=schema)
            counts = np.array([len(t) for t, _ in cut], np.int64)
            row = np.repeat(np.arange(len(nodes)), counts)
            tokens, salts = np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in cut]]), np.concatenate([np.zeros(0, np.int64), *[s for _, s in cut]])
            places = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
            mixed = (nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            owner = ((tokens >> _CUT).astype(np.int64) % 1_000_003 + mixed[row] % salts * 7919) % known.owners
            by_owner = np.lexsort((tokens, owner))
            bounds = np.flatnonzero(np.diff(owner[by_owner], prepend=-1, append=known.owners))
            blobs = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                at = by_owner[a:b]
                blobs.append(pack_rows(tokens[at] >> _CUT, nodes[row[at]], np.array(sizes, np.int32)[row[at]], places[at]))
            none = [pa.nulls(len(blobs), schema.field(k).type) for k in range(2, 6)]
            yield pa.record_batch([pa.array(owner[by_owner[bounds[:-1]]].astype(np.int32)), pa.array(blobs, pa.binary()), *none], schema=schema)

    return texts.select("node", "text").mapInArrow(run, "owner int, rows binary, node long, fp long, size int, bits binary")


_STAR = "token long, lead long, lead_size int, lead_place int, node long, size int, place int"


def token_stars(packed: DataFrame, order: Order) -> DataFrame:
    """A row of _STAR for each token and text but the first (the least node) of those that share the token at an owner. Of
    a salted token, whose texts have several owners, the first texts of all owners come too, led by the least."""
    salted = np.sort(order.known[order.salts > 1] >> _CUT)
    columns = [c.split(" ")[0] for c in _STAR.split(", ")]

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_rows(bytes(b)) for b in group["rows"]]
        tokens, nodes, sizes, places = [np.concatenate(x) for x in zip(*parts, strict=True)]
        at = np.lexsort((nodes, tokens))
        tokens, nodes, sizes, places = tokens[at], nodes[at], sizes[at], places[at]
        first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        use = nodes != nodes[lead]
        if len(salted):
            use |= first & np.isin(tokens, salted)
        lead = lead[use]
        found = (tokens[use].astype(np.int64), nodes[lead], sizes[lead], places[lead], nodes[use], sizes[use], places[use])
        return pd.DataFrame(dict(zip(columns, found, strict=True)))

    found = written(packed.groupBy("owner").applyInPandas(meet, _STAR), "simhash-met")
    if not len(salted):
        return found
    wanted = found.sparkSession.createDataFrame([(t,) for t in salted.astype(np.int64).tolist()], "token long")
    leads = found.join(F.broadcast(wanted), "token", "left_semi").groupBy("token", "lead").agg(F.min("lead_size").alias("lead_size"), F.min("lead_place").alias("lead_place"))
    top = leads.groupBy("token").agg(F.min(F.struct("lead", "lead_size", "lead_place")).alias("top"))
    among = leads.join(top, "token").select("token", "top.*", F.col("lead").alias("node"), F.col("lead_size").alias("size"), F.col("lead_place").alias("place"))
    return written(found.filter("node <> lead").unionByName(among.filter("node <> lead").select(*columns)), "simhash-met-salted")


def _possible(similarity: float, a: str, b: str) -> Column:
    """Whether sets of these sizes that first share the tokens at these places can be similar enough."""
    sizes, places = [F.col(f"{x}size") for x in (a, b)], [F.col(f"{x}place") for x in (a, b)]
    room = 1 + F.least(sizes[0] - 1 - places[0], sizes[1] - 1 - places[1])
    overlap = similarity / (1 + similarity) * (sizes[0] + sizes[1]) - 1e-9
    return (F.least(*sizes) >= similarity * F.greatest(*sizes)) & (room >= overlap)


def plausible(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) without those whose bitmaps tell that their sets (marks: node, size, bits) differ in too many elements. Of sets that
    share a passage alone this rules out nearly all, for a fraction of what the sets weigh, and never one that is similar."""
    bounded_batches(pairs.sparkSession)
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(4).to_numpy(zero_copy_only=False)
            both = zip(sizes, batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([least_difference(x, y) <= share * n + 1e-9 for n, x, y in both], pa.bool_()))

    # equal bitmaps make small files, so nothing but counted pairs is broadcast
    known = joined_with(marks.toDF("a", "a_size", "a_bits").hint("merge"), pairs.select("a", "b"), pairs.count(), "a")
    known = known.join(marks.toDF("b", "b_size", "b_bits").hint("merge"), "b")
    # rows that share an id may give a pair more than once
    return known.select("a", "b", "a_size", "a_bits", "b_size", "b_bits").mapInArrow(run, "a long, b long").distinct()


def similar_pairs(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets of shingles have a Jaccard similarity of at least similarity."""
    bounded_batches(texts.sparkSession)
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "simhash-wanted")
    sets_schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(shingles(t, shingle), 42)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], schema=sets_schema)

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(common >= similarity * (len(s) + len(t) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = written(joined_with(texts.select("node", "text"), wanted, wanted.count(), "node", "left_semi").mapInArrow(cut, "node long, set binary"), "simhash-sets")
    # equal sets make small files, so they are never broadcast
    both = pairs.select("a", "b").join(sets.toDF("a", "s").hint("merge"), "a").join(sets.toDF("b", "t").hint("merge"), "b").select("a", "b", "s", "t")
    return both.mapInArrow(enough, "a long, b long")


def _apart(pairs: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose ends are in different groups."""
    for end in (a, b):
        pairs = pairs.join(groups.toDF(f"{end}_node", f"{end}_root"), F.col(end) == F.col(f"{end}_node"), "left").drop(f"{end}_node")
    return pairs.filter(F.coalesce(f"{a}_root", a) != F.coalesce(f"{b}_root", b)).drop(f"{a}_root", f"{b}_root")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """node and root for every document that is in a group with others: groups are the connected components of all pairs
    whose sets of shingles have a Jaccard similarity of at least similarity.

    First candidates are fingerprints that meet at an anchor and differ in at most 3 bits. Beyond these every pair is found by prefix filtering:
    it shares one of the first shingles of both sets. For each such shingle the least document is compared with each other; these
    stars join most of a large group of near copies at a linear number of comparisons. Then, of shingles whose star fell apart, the pairs
    that are still in different groups are compared, all of them."""
    texts = docs.select(_keyed(docs, id_col, text_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    order = token_order(texts, shingle, similarity)
    signed = written(signatures(texts, shingle, similarity, order), "simhash-signatures")
    prints = signed.filter("rows IS NULL").select("node", "fp")
    nodes = written(prints.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("times")), "simhash-nodes")
    n, rows = nodes.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    close = _meetings(nodes, TRIPLES if n > MANY else HALVES, 3, ("node",)).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    several = nodes.filter("times > 1").select("fp", F.col("node").alias("a"), "times")
    same = looked_up(prints, several, ["fp"], "times", max(1000, rows // 1000), shuffled=True).filter("node > a").select("a", F.col("node").alias("b"))

    met = token_stars(signed.filter("rows IS NOT NULL").select("owner", "rows"), order)
    stars = met.groupBy("lead", "node").agg(F.max(_possible(similarity, "lead_", "")).alias("possible"))
    stars = written(stars, "simhash-stars")
    first = stars.filter("possible").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    first = written(close.unionByName(same).unionByName(first).distinct(), "simhash-candidates")
    marks = signed.filter("rows IS NULL").select("node", "size", "bits")
    likely = written(plausible(first, marks, similarity), "simhash-likely")
    groups = components(similar_pairs(texts, likely, shingle, similarity))

    fell = written(_apart(stars.select("lead", "node"), groups, "lead", "node"), "simhash-apart")
    n = fell.count()
    if not n:
        return groups
    tokens = written(joined_with(met.hint("merge"), fell, n, ["lead", "node"], "left_semi").select("token").distinct(), "simhash-tokens")
    open_ = joined_with(met, tokens, tokens.count(), "token", "left_semi")
    ends = open_.select("token", "node", "size", "place").unionByName(open_.select("token", F.col("lead").alias("node"), F.col("lead_size").alias("size"), F.col("lead_place").alias("place")))
    ends = ends.distinct().join(groups.toDF("g_node", "root"), F.col("node") == F.col("g_node"), "left")
    ends = written(ends.select("token", "node", "size", "place", F.coalesce("root", "node").alias("of")), "simhash-open")
    a, b = (ends.toDF("token", *[f"{end}_{c}" for c in ("node", "size", "place", "of")]) for end in "ab")
    rest = a.join(b, "token").filter("a_node < b_node AND a_of <> b_of").filter(_possible(similarity, "a_", "b_"))
    rest = rest.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    rest = joined_with(rest.hint("merge"), first, first.count(), ["a", "b"], "left_anti")
    rest = written(plausible(rest, marks, similarity), "simhash-rest")
    similar = similar_pairs(texts, rest, shingle, similarity)
    known = groups.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(known.unionByName(similar))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the smallest id of each group of similar_texts(); all columns as they were. A row without an id stays
    only in a group where no row has one."""
    (name,) = free_names(docs, "near_node")
    gone = written(similar_texts(docs, id_col, text_col, **options).filter("node <> root").select(F.col("node").alias(name)), "simhash-gone")
    return joined_with(docs.hint("merge"), gone, gone.count(), [_keyed(docs, id_col, text_col) == F.col(name)], "left_anti")
