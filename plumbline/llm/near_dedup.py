"""Near-duplicate documents: MinHash banding, sequential Bayesian verification, exact check.

1. Every text becomes a set of five-word shingles, 288 MinHash values
   and ``BANDS`` band keys. Texts with the same words are folded into one
   representative (the smallest id) before anything is compared.
2. Documents sharing a band key are candidates, but a bucket is not expanded
   into its pairs. In a round every bucket that still holds several components
   names a hub, and every member proposes the one best hub among its buckets:
   at most one comparison a document. Links join components, links inside one
   component are dropped and buckets of one component leave.
3. When hubs link nothing more, buckets of at most ``LISTED`` members give
   their pairs. The documents of larger ones (many texts around one passage,
   say) meet over an exact index instead: each lists the rarest shingles of its
   set, of which two sets at the threshold share at least one, together with
   the largest partner that it could still link with if that shingle is the
   first they share. Documents without a possible partner leave before any pair
   is formed. So no pair of a bucket is left out, whatever the bucket's size,
   unless it is excluded by proof or already connected.
4. A candidate pair is verified sequentially: after each batch of signature
   values the posterior probability (uniform prior) that its similarity
   reaches the threshold is compared with ``MISS``, and the pair is pruned
   below it. Survivors are compared on their full shingle sets, so a reported
   link is exact. A pair of similarity 0.75 is missed by banding with
   probability (1 - 0.75**6)**48 = 8e-5 and by pruning with at most ``MISS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, dropped, small_or_shuffled, stored, with_text_batches
from plumbline.llm.components import composed, connected_components
from plumbline.llm.shingles import shingle_set, words
from xxhash import xxh3_128_digest

#: Bands and rows of a band.
BANDS, ROWS = 48, 6
#: Members up to which a bucket gives all its pairs.
LISTED = 8
#: Signature values of a verification (one byte each) and their batches.
VERIFY, BATCH = 192, 32
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Probability of pruning a pair that reaches the threshold, over all batches.
MISS = 1e-4
#: Rounds of hubs; a round without a link ends them earlier.
HUB_ROUNDS = 5
#: Slots of the count of shingles by which the index orders them. A fixed size; the order alone, not the result, depends on it.
SLOTS = 2**18

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint64).astype(np.uint32)
_ODD = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_KEYS = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

_SIGNED = "doc_id long, copies long, digest binary, n_shingles long, sig binary, bands array<long>"
_PAIR = "a long, b long, component_a long, component_b long"


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The minima of each hash function over a non-empty shingle set, in blocks that stay in cache."""
    low = None
    half = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    work = np.empty((len(_XOR), min(512, len(half))), np.uint32)
    for at in range(0, len(half), 512):
        block = half[at : at + 512]
        out = work[:, : len(block)]
        np.bitwise_xor(block, _XOR, out=out)
        np.multiply(out, _ODD, out=out)
        least = out.min(axis=1)
        low = least if low is None else np.minimum(low, least)
    return low


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of the key."""
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    key = (rows * _KEYS).sum(axis=1, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def verified_bytes(signature: np.ndarray) -> bytes:
    """One byte of each of the first minima, mixed: minima of many shingles are small, so their top bytes agree by chance."""
    return ((signature[:VERIFY] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            tokens = words(text)
            shingles = shingle_set(tokens)
            if len(shingles):
                signature = minhash(shingles)
                rows.append((xxh3_128_digest(b" ".join(tokens)), len(shingles), verified_bytes(signature), band_keys(signature)))
            else:
                rows.append((None, 0, None, None))
        signed = pd.DataFrame(rows, columns=["digest", "n_shingles", "sig", "bands"], index=pdf.index)
        yield pd.concat([pdf[["doc_id", "copies"]], signed], axis=1)


@lru_cache(maxsize=None)
def least_matches(percent: int = PERCENT, verify: int = VERIFY, batch: int = BATCH, miss: float = MISS) -> tuple[int, ...]:
    """For each batch end n, the fewest matches whose pair is kept.

    With a uniform prior the posterior of the match rate after m matches in n
    is Beta(m+1, n-m+1), and P(rate >= t) = P(Binomial(n+1, t) <= m). Values of
    one byte also match by chance, hence t is the threshold's match rate.
    """
    s = percent / 100
    t = s + (1 - s) / 256
    share = miss * batch / verify
    found = []
    for n in range(batch, verify + 1, batch):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= share:
                break
            m += 1
        found.append(m)
    return tuple(found)


def _plausible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prune pairs batch by batch of signature values; only those still alive read the next batch."""
    for pdf in batches:
        if not len(pdf):
            continue
        left = np.frombuffer(b"".join(pdf["sig_a"]), np.uint8).reshape(-1, VERIFY)
        right = np.frombuffer(b"".join(pdf["sig_b"]), np.uint8).reshape(-1, VERIFY)
        alive, matches = np.arange(len(pdf)), np.zeros(len(pdf), np.int32)
        for k, least in enumerate(least_matches()):
            span = slice(k * BATCH, (k + 1) * BATCH)
            matches[alive] += (left[alive, span] == right[alive, span]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        yield pdf.iloc[alive][["a", "b", "component_a", "component_b"]]


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links among pairs of whole texts; the sets of recent documents are kept for their next pairs."""
    kept_sets: dict[int, np.ndarray] = {}

    def of(doc_id: int, text: str) -> np.ndarray:
        if doc_id not in kept_sets:
            if len(kept_sets) >= 1024:
                kept_sets.clear()
            kept_sets[doc_id] = shingle_set(words(text))
        return kept_sets[doc_id]

    for pdf in batches:
        linked = []
        for row, (a, b, text_a, text_b) in enumerate(zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"], strict=True)):
            left, right = of(a, text_a), of(b, text_b)
            common = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * common >= PERCENT * (len(left) + len(right) - common):
                linked.append(row)
        yield pdf.iloc[linked][["a", "b", "component_a", "component_b"]]


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given ids."""
    return rows.join(small_or_shuffled(ids, ids.count()), "doc_id", "left_semi")


def _buckets(keys: DataFrame) -> DataFrame:
    """band, doc_id, n of the buckets with n > 1 members."""
    keyed = keys.select(F.explode(F.array_distinct("bands")).alias("band"), "doc_id")
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(shared, "band").select("band", "doc_id", "n")


def _with_both(pairs: DataFrame, rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(pairs with a column of both documents, the stored table of that column)."""
    ids = checkpointed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    needed = stored(_only(rows, ids).select("doc_id", column), "ends")
    left, right = (needed.select(F.col("doc_id").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "component_a", "component_b", f"{column}_a", f"{column}_b"), needed


def _links(pairs: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact links among candidate pairs (a, b) of two components."""
    pairs = checkpointed(pairs)
    with_sigs, sigs = _with_both(pairs, signed, "sig")
    alive = checkpointed(with_sigs.mapInPandas(_plausible, _PAIR))
    with_texts, needed = _with_both(alive, texts, "text")
    links = checkpointed(with_texts.mapInPandas(_exact, _PAIR))
    for table in (sigs, needed):
        dropped(table)
    return links


def _open(rows: DataFrame) -> DataFrame:
    """The rows (band, doc_id, component, ...) of the buckets that hold several components."""
    several = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return rows.join(several.select("band"), "band", "left_semi")


def _hub_pairs(rows: DataFrame, order: Column) -> DataFrame:
    """For each document of open buckets the best hub among them, unless they share a component."""
    hubs = rows.groupBy("band").agg(F.max(F.struct(order.alias("at"), F.negative("doc_id").alias("minus_id"), "component")).alias("hub"))
    met = rows.join(hubs, "band").where("component <> hub.component")
    best = met.groupBy("doc_id", "component").agg(F.max("hub").alias("hub"))
    return best.select(F.negative("hub.minus_id").alias("a"), F.col("doc_id").alias("b"), F.col("hub.component").alias("component_a"), F.col("component").alias("component_b"))


def _paired(rows: DataFrame, key: str, *where: str) -> DataFrame:
    """Pairs of two components that share a key."""
    a, b = (rows.select(key, *(F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != key)) for x in "ab")
    met = a.join(b, key).where("doc_id_a < doc_id_b and component_a <> component_b")
    for condition in where:
        met = met.where(condition)
    return met.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), "component_a", "component_b").distinct()


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(SLOTS)).astype(np.int64)


def _slot_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(SLOTS, np.int64)
    for pdf in batches:
        for text in pdf["text"]:
            counts += np.bincount(_slots(shingle_set(words(text))), minlength=SLOTS)
    some = np.flatnonzero(counts)
    yield pd.DataFrame({"slot": some, "n": counts[some]})


def rarest(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, largest partners): the part of a set that any set at the threshold shares.

    Shingles are ordered by count, then value. If the first shared one stands at
    place i, at most n - i are shared, so a partner has at most
    (100 + PERCENT) * (n - i) / PERCENT - n shingles. Shingles that no other set
    has are left out.
    """
    n, of = len(shingles), counts[_slots(shingles)]
    order = np.lexsort((shingles, of))[: n - -(-PERCENT * n // 100) + 1]
    most = (100 + PERCENT) * (n - np.arange(len(order))) // PERCENT - n
    shared = of[order] > 1
    return shingles[order][shared], most[shared]


def _rarest(counts):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(words(text)) for text in pdf["text"]]
            parts = [rarest(s, counts.value) for s in sets]
            rows = pdf[["doc_id", "component"]].assign(n=[len(s) for s in sets])
            rows = rows.loc[rows.index.repeat([len(keys) for keys, _ in parts])]
            if len(rows):
                yield rows.assign(shingle=np.concatenate([k for k, _ in parts]).view(np.int64), most=np.concatenate([m for _, m in parts]))

    return run


def index_pairs(docs: DataFrame) -> DataFrame:
    """Pairs of two components of ``docs`` (doc_id, component, text) that may reach the threshold, without one that does left out."""
    counts = np.zeros(SLOTS, np.int32)
    # at most SLOTS numbers, whatever the table
    found = docs.select("text").mapInPandas(_slot_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**31 - 1)
    index = docs.mapInPandas(_rarest(docs.sparkSession.sparkContext.broadcast(counts)), "doc_id long, component long, n int, shingle long, most int")
    index = stored(index, "index")
    sizes = index.groupBy("shingle").agg(F.min("n").alias("least"), F.count("*").alias("sets")).where("sets > 1")
    live = index.join(sizes, "shingle").where("most >= least").select(*index.columns)
    return _paired(live, "shingle", "n_a <= most_b and n_b <= most_a")


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, copies: one row for each id, with its smallest text, and each row without an id."""
    rows = with_text_batches(docs)
    repeats = checkpointed(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies")).where("copies > 1"))
    n = repeats.count()
    if not n:
        return rows.withColumn("copies", F.lit(1).cast("long"))
    repeats = small_or_shuffled(repeats, n)
    once = rows.join(repeats, "doc_id", "left_anti").withColumn("copies", F.lit(1).cast("long"))
    return once.unionByName(rows.join(repeats, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("copies").alias("copies")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``doc_id, n_shingles, component_id, kept``, a row for each input row.

    ``n_shingles`` is the size of the document's set of five-word shingles,
    ``component_id`` the smallest id reachable over links of similarity 0.75 or
    more, ``kept`` whether that is the document itself. Null and empty texts
    have no shingles and link with nothing. A row without an id is kept and has
    a null component. Rows that repeat an id are one document and each get its
    row; if their texts differ, the smallest text is the document's. Texts of
    any length are read whole. Other columns are ignored; an empty table gives
    an empty result.
    """
    texts = _documents(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    signed = stored(texts.select("doc_id", "copies", "text").mapInPandas(_sign, _SIGNED), "signed")
    heads = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    heads = checkpointed(heads)
    # one row for each distinct text
    others = signed.select("doc_id", "digest").where("digest is not null").join(heads, "digest").where("doc_id <> first_id").select("doc_id")
    others = checkpointed(others)
    own = signed.where("digest is not null and doc_id is not null").join(small_or_shuffled(others, others.count()), "doc_id", "left_anti")
    members = stored(_buckets(own), "buckets")
    # the hub of a bucket is the member that meets most others over all buckets
    scores = members.groupBy("doc_id").agg(F.sum("n").alias("score"))
    rows = stored(members.join(scores, "doc_id").withColumn("component", F.col("doc_id")), "members")
    dropped(members)
    labels = None
    for at in range(HUB_ROUNDS + 1):
        hubs = at < HUB_ROUNDS and (labels is None or merged.limit(1).count())
        if hubs:
            pairs = _hub_pairs(rows.where("n > 2") if labels is None else rows, F.col("score") if labels is None else F.xxhash64("doc_id", F.lit(at)))
        else:
            few = _paired(rows.where(F.col("n") <= LISTED).select("band", "doc_id", "component"), "band")
            crowded = checkpointed(rows.where(F.col("n") > LISTED).select("doc_id", "component").distinct())
            pairs = few
            if n := crowded.count():
                crowd = stored(texts.select("doc_id", "text").join(small_or_shuffled(crowded, n), "doc_id"), "crowd")
                pairs = few.union(index_pairs(crowd)).distinct()
        found = _links(pairs, own, texts)
        merged = connected_components(found.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
        labels = merged if labels is None else checkpointed(composed(labels, merged))
        if not hubs:
            break
        now = merged.select(F.col("node").alias("component"), F.col("component").alias("later"))
        still = rows.join(now, "component", "left").withColumn("component", F.coalesce("later", "component")).select(*rows.columns)
        still = stored(_open(still), "open")
        dropped(rows)
        rows = still
    dropped(rows)
    classes = heads.join(labels, heads.first_id == labels.node, "left").select("digest", F.coalesce("component", "first_id").alias("component"))
    return (
        signed.select("doc_id", "copies", "digest", "n_shingles")
        .join(classes, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .drop("copy")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of near-duplicates.

    Of rows that repeat an id one stays, with the smallest text, which is the
    document's. Rows without an id stay; so do null and empty texts, which link
    with nothing. An empty table gives an empty result.
    """
    verdicts = near_duplicates(docs, doc_id, text).where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    verdicts = verdicts.agg(F.count_if("kept").alias("_kept")).where("_kept <> 1")
    verdicts = stored(verdicts, "verdicts")
    # the ids that go are the smaller side; rows without an id match none and stay
    same = docs[doc_id].cast("long")
    gone = verdicts.where("_kept = 0").select("_id")
    rows = docs.join(small_or_shuffled(gone, gone.count()), same == gone["_id"], "left_anti")
    again = verdicts.where("_kept > 1").select("_id")
    if n := again.count():
        again = small_or_shuffled(again, n)
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        first = rows.join(again, same == again["_id"]).groupBy("_id").agg(F.min_by(whole, F.coalesce(F.concat(F.lit("1"), F.col(f"`{text}`")), F.lit("2"))).alias("_row"))
        rows = rows.join(again, same == again["_id"], "left_anti").unionByName(first.select("_row.*"))
    return rows
