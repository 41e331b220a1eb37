"""Near-copy groups: an exact n-gram Jaccard join with token-combination prefixes.

Tokens are hashes of ``WORDS`` words in a row; a text is the set of its tokens. Two texts link when
their sets' Jaccard similarity is at least 3/4. The steps:

1. Texts with equal sets become one class, told by two commutative 64-bit sums over the set.
2. Document frequencies. Tokens go to buckets by hash, packed (about 7 to 14 bytes each), and a
   bucket's task counts in how many classes each token occurs. Tokens of one class only are dropped;
   they come first in the global order (frequency, token), so only their number matters. A class
   that shares less than 3/4 of its tokens with others links with none and is done.
3. Prefixes. In the global order, a set of n tokens can miss at most floor(n / 4) of a partner's. Its
   first floor(n / 4) + 1 tokens therefore hold a common one. Rare tokens (frequency up to ``RARE``)
   are indexed alone. Frequent tokens are dealt to M subclasses and indexed as pairs within a
   subclass; for that the prefix is extended by M tokens: of M + 1 common ones, two share a subclass.
   M grows with the size of the set (``combinations``), and sets that may link share a size level.
4. Verification on the sets. Each signature first compares its members with one pivot (a star); what
   links becomes one component. Only members of different components are compared further: by
   stars with other pivots while many pairs are left and stars still help, then all that remain.
   So no pair of different components that share a signature is left out. Bitmaps of the sets bound
   the overlap of a pair from above first, exactly, so that whole sets are only brought together
   for pairs that may link. Members of crowded signatures are not joined to pairs at all: their
   bitmaps meet in blocks within the families that the crowded signatures connect, and only the
   pairs that may link leave a block.

Components are found by label propagation with pointer jumping, on the cluster.

Edge cases: a null text, or one without words, has 0 tokens, links with nothing and is its own
component; with fewer than ``WORDS`` words the whole sequence is the one token; rows with a null id
take no part and have a null component; an id that occurs twice is one document with two rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bytes_of, id_and_text, slices
from .hashing import WHITE, Texts, first_of, mix, runs
from .shared import checkpointed, written

WORDS = 5
RARE = 32
#: Tokens of one bucket, about; and the bits of a token that are kept besides its bucket.
BUCKET_TOKENS = 1 << 20
TOKEN_BYTES = 5
#: Stars go on while the pairs left are more than this many times the signatures and each star halves them, at most so often.
STAR_FACTOR, STARS = 4, 6
BITMAP_BYTES = 512
#: Members from which a signature is crowded, and members of one block of a family.
CROWDED, BLOCK = 24, 256
COUNT_SLICE = 1 << 20


def token_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of all texts in a row, sorted within a text, and how many each text has."""
    data, offsets = bytes_of(texts)
    t = Texts(data, offsets, lowered=True)
    starts, ends = t.stretches(WHITE)
    first = first_of(starts, offsets)
    counts, hashes = np.diff(first), t.hashes(starts, ends)
    grams = runs(hashes, words)
    text_of = np.repeat(np.arange(len(counts)), counts)
    inside = text_of[:len(grams)] == text_of[words - 1:] if len(grams) else np.zeros(0, bool)
    owner, tokens = text_of[:len(grams)][inside], grams[inside]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = [runs(hashes[first[k]:first[k + 1]], int(counts[k]))[0] ^ np.uint64(counts[k]) for k in short]
        owner, tokens = np.concatenate([owner, short]), np.concatenate([tokens, np.array(whole, np.uint64)])
    order = np.lexsort((tokens, owner))
    owner, tokens = owner[order], tokens[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])
    return tokens[new], np.bincount(owner[new], minlength=len(counts))


def _sums(tokens: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(salt)))])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _keys(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return mix(_sums(tokens, counts, 0x51ED270B) + counts.astype(np.uint64)).view(np.int64)


def memberships(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n (distinct tokens) and the two keys of the set, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            tokens, counts = token_sets(part.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(counts, pa.int64()), pa.array(_keys(tokens, counts)), pa.array(_sums(tokens, counts, 0x7F4A7C15).view(np.int64))],
                names=["id", "n", "key", "key2"],
            )

    return id_and_text(docs, id_col, text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(run, "id long, n long, key long, key2 long")


def shared_tokens(docs: DataFrame, id_col: str, text_col: str, words: int, total: int) -> DataFrame:
    """key, token, df for every token that occurs in at least two classes."""
    bits = max(0, (total // BUCKET_TOKENS).bit_length())
    rest = np.uint64(64 - bits - 8 * TOKEN_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, COUNT_SLICE):
            tokens, counts = token_sets(part.column("text"), words)
            keys = _keys(tokens, counts)
            once = np.zeros(len(keys), bool)  # equal sets of this slice count once
            once[np.unique(keys, return_index=True)[1]] = True
            tokens, owner = tokens[np.repeat(once, counts)], np.repeat(np.flatnonzero(once), counts[once])
            bucket = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
            order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
            bucket, owner = bucket[order], owner[order]
            small = np.ascontiguousarray((tokens[order] >> rest).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for a, b in zip(cut, np.append(cut[1:], len(bucket))):
                run_start = a + np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                lengths = np.diff(np.append(run_start, b)).astype(np.uint32)
                rows.append((bucket[a], keys[owner[run_start]].tobytes(), lengths.tobytes() if lengths.max() > 255 else lengths.astype(np.uint8).tobytes(), small[a:b].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "keys", "lengths", "tokens"])

    def count(table: pa.Table) -> pa.Table:
        keys, tokens = [], []
        for k, n, t in zip(*(table.column(c).to_pylist() for c in ("keys", "lengths", "tokens"))):
            owners = np.frombuffer(k, np.int64)
            lengths = np.frombuffer(n, np.uint8 if len(n) == len(owners) else np.uint32)
            keys.append(np.repeat(owners, lengths))
            tokens.append(np.frombuffer(t, np.uint8).reshape(-1, TOKEN_BYTES))
        keys, small = np.concatenate(keys), np.concatenate(tokens)
        wide = np.zeros((len(small), 8), np.uint8)
        wide[:, :TOKEN_BYTES] = small
        token = wide.view("<u8").ravel()
        order = np.argsort(token, kind="stable")
        token, keys = token[order], keys[order]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        at = np.flatnonzero(new)
        many = np.repeat(np.diff(np.append(at, len(token))) > 1, np.diff(np.append(at, len(token))))
        token, keys = token[many], keys[many]
        order = np.lexsort((keys, token))
        token, keys = token[order], keys[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (keys[1:] != keys[:-1])
        token, keys = token[new], keys[new]
        _, back, df = np.unique(token, return_inverse=True, return_counts=True)
        df = df[back] if len(token) else np.zeros(0, np.int64)
        high = np.int64(int(table.column("bucket")[0].as_py()) << (8 * TOKEN_BYTES))
        keep = df > 1
        return pa.table({"key": keys[keep], "token": token[keep].astype(np.int64) | high, "df": df[keep].astype(np.int32)})

    packed = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(pack, "bucket long, keys binary, lengths binary, tokens binary")
    return packed.groupBy("bucket").applyInArrow(count, "key long, token long, df int")


def combinations(level: int) -> int:
    """Subclasses of frequent tokens for sets of 2**level to 2**(level + 1) tokens; 0: all tokens are indexed alone."""
    return 0 if level == 0 else max(1, (1 << level) // 16)


def _levels(n: int) -> range:
    return range((-(-3 * n // 4)).bit_length() - 1, (4 * n // 3).bit_length())


def signatures_of(n: int, tokens: np.ndarray, df: np.ndarray, rare_df: int = RARE) -> np.ndarray:
    """Signatures of a set of n tokens; ``tokens`` are its shared ones in the global order, with their frequencies."""
    private, miss = n - len(tokens), n // 4
    out = []
    for level in _levels(n):
        m = combinations(level)
        size = miss + 1 - private
        if m and size <= len(tokens) and size > 0 and df[size - 1] > rare_df:
            size += m
        if size <= 0:
            continue
        head = tokens[:size].astype(np.uint64)
        rare = df[:size] <= rare_df if m else np.ones(len(head), bool)
        out.append(mix(head[rare]))
        often = head[~rare]
        if len(often) > 1:
            group = (mix(often ^ np.uint64(level)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            often, group = often[order], group[order]
            for step in range(1, int(np.bincount(group).max())):
                same = group[step:] == group[:-step]
                out.append(mix(often[:-step][same] * np.uint64(0x9E3779B97F4A7C15) + mix(often[step:][same] + np.uint64(level))))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def signatures(sets: DataFrame, rare_df: int) -> DataFrame:
    """sig, rep, n for every signature of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, rep = part.column("n").to_numpy(), part.column("rep").to_numpy()
                found = [
                    signatures_of(int(k), t.values.to_numpy(zero_copy_only=False), d.values.to_numpy(zero_copy_only=False).astype(np.int64), rare_df)
                    for k, t, d in zip(n, part.column("tokens"), part.column("df"))
                ]
                sizes = [len(f) for f in found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(rep, sizes)), pa.array(np.repeat(n, sizes))], names=["sig", "rep", "n"])

    return sets.select("rep", "n", "tokens", "df").mapInArrow(run, "sig long, rep long, n long")


def _may_link(n: str, other: str):
    return (F.col(n) * 4 >= F.col(other) * 3) & (F.col(other) * 4 >= F.col(n) * 3)


def bitmaps(sets: DataFrame) -> DataFrame:
    """rep, n, k (shared tokens) and a bitmap of the shared tokens for every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tokens in batch.column("tokens"):
                bits = np.zeros(BITMAP_BYTES * 8, np.uint8)
                bits[(mix(tokens.values.to_numpy(zero_copy_only=False).astype(np.uint64)) % np.uint64(BITMAP_BYTES * 8)).astype(np.int64)] = 1
                rows.append(np.packbits(bits).tobytes())
            sizes = pa.array([len(t) for t in batch.column("tokens")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), sizes, pa.array(rows, pa.binary())], names=["rep", "n", "k", "bits"])

    return sets.select("rep", "n", "tokens").mapInArrow(run, "rep long, n long, k long, bits binary")


def _most_common(x: np.ndarray, y: np.ndarray, k_x: np.ndarray, k_y: np.ndarray) -> np.ndarray:
    """Upper bound of the common tokens: a bit that only one has stands for a token that the other lacks."""
    only_x, only_y = (np.bitwise_count(d).sum(-1, dtype=np.int64) for d in (x & ~y, y & ~x))
    return np.minimum(k_x - only_x, k_y - only_y)


def _words(bits: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(bits), -1)


def possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b, k_a, k_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b", "k_a", "k_b"))
                most = _most_common(_words(batch.column("bits_a")), _words(batch.column("bits_b")), k_a, k_b)
                yield batch.filter(pa.array(most * 100 >= (n_a + n_b - most) * 75)).select(["a", "b"])

    sides = [bits.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "k", "bits")]) for c in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(run, "a long, b long")


def family_pairs(crowded: DataFrame, bits: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) with different labels that may link, among all members of a family.

    ``crowded`` has rep, label and p_rep, a member of the same signature. Members that are connected
    so form a family; a family is cut into blocks, and every two blocks are compared by one task.
    """

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, label, n, k, part = (table.column(c).to_numpy() for c in ("rep", "label", "n", "k", "part"))
        words, found = _words(table.column("bits").combine_chunks()), []
        low, high = int(table.column("low")[0].as_py()), int(table.column("high")[0].as_py())
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        for at in range(0, len(left), 16):
            i = left[at:at + 16]
            most = _most_common(words[i][:, None], words[right][None], k[i][:, None], k[right][None])
            union = n[i][:, None] + n[right][None] - most
            x, y = np.nonzero((most * 100 >= union * 75) & (label[i][:, None] != label[right][None]))
            found.append(np.stack([rep[i[x]], rep[right[y]]]))
        pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": np.minimum(*pairs), "b": np.maximum(*pairs)})

    links = crowded.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")).distinct()
    families = connected(links, None).withColumnRenamed("label", "family")
    sizes = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    members = families.join(sizes, "family").join(crowded.select("rep", "label").distinct(), "rep").join(bits, "rep")
    members = members.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("rep", "label", "n", "k", "bits", "part", "family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    return met.groupBy("family", "low", "high").applyInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the intersection of their sets."""
    one = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a"), F.col("n").alias("n_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b"), F.col("n").alias("n_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", common.alias("common"))
    return both.filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * 75).select("a", "b")


def connected(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rep, label: the smallest id reachable over ``links`` and the labels found before.

    The tables of the loop are written and read again: a checkpointed table keeps the estimated size of
    its plan, and estimates that are multiplied from round to round grow without bound.
    """
    edges = links.select("a", "b")
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    edges = edges.filter("a <> b")
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("rep"), F.least("a", "b").alias("label")))
    while True:
        offered = edges.join(labels, edges["b"] == labels["rep"]).groupBy("a").agg(F.min("label").alias("offer"))
        better = labels.join(offered, labels["rep"] == offered["a"]).select("rep", F.col("label").alias("old"), F.least("label", "offer").alias("near"))
        jump = labels.select(F.col("rep").alias("near"), F.col("label").alias("far"))
        new = written(better.join(jump, "near", "left").select("rep", "old", F.least("near", "far").alias("label")))
        labels = new.select("rep", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, rare_df: int = RARE, stars: int = STARS, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` of every row of ``docs``; ids are integers."""
    members = checkpointed(memberships(docs, id_col, text_col, words))
    total = members.agg(F.sum("n")).first()[0] or 0
    classes = members.filter("n > 0").groupBy("key", "key2", "n").agg(F.min("id").alias("rep"))
    shared = shared_tokens(docs, id_col, text_col, words, total).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found"))
    sets = shared.join(classes.filter("rep IS NOT NULL").select("key", "n", "rep"), "key").filter(F.size("found") * 4 >= F.col("n") * 3)
    sets = checkpointed(sets.select("rep", "n", F.col("found.token").alias("tokens"), F.col("found.df").alias("df")))
    labels = _labels(sets, rare_df, stars, crowded, block)
    out = members.join(classes.withColumnRenamed("n", "size"), ["key", "key2"], "left").join(labels, "rep", "left")
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.coalesce("label", "rep"))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _labels(sets: DataFrame, rare_df: int, stars: int, crowded: int, block: int) -> DataFrame:
    """rep, label for every class that links with another."""
    active, bits = checkpointed(signatures(sets, rare_df)), checkpointed(bitmaps(sets))
    rows, labels, before = active.count(), None, None
    for star in range(stars + 1):
        if labels is None:
            named = active.withColumn("label", F.col("rep"))
        else:
            named = active.join(labels, "rep", "left").select("sig", "rep", "n", F.coalesce("label", "rep").alias("label"))
        groups = named.groupBy("sig").agg(F.min(F.struct(F.xxhash64("rep", F.lit(star)), "rep", "n", "label")).alias("pivot"), F.min("label").alias("least"), F.max("label").alias("most"))
        groups = groups.filter("least <> most").select("sig", "pivot.rep", "pivot.n", "pivot.label")
        groups = groups.select("sig", F.col("rep").alias("p_rep"), F.col("n").alias("p_n"), F.col("label").alias("p_label"))
        apart = checkpointed(named.join(groups, "sig"))  # groups of more than one component
        active = apart.select("sig", "rep", "n")
        sizes = apart.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("sig").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"))
        left = sizes.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            break
        last = star == stars or star > 0 and (left <= STAR_FACTOR * rows or 2 * left > before)
        before = left
        if last:
            crowds = apart.groupBy("sig").agg(F.count(F.lit(1)).alias("k"))
            apart = apart.join(crowds, "sig")
            few = apart.filter(F.col("k") < crowded)
            mine = few.select("sig", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"))
            other = few.select("sig", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"))
            pairs = mine.join(other, "sig").filter((F.col("label_a") < F.col("label_b")) & _may_link("n_a", "n_b")).select("a", "b").distinct()
            many = apart.filter(F.col("k") >= crowded).select("rep", "label", "p_rep")
            found = possible(pairs, bits).unionByName(family_pairs(many, bits, block)).distinct()
        else:
            pairs = apart.filter((F.col("label") != F.col("p_label")) & _may_link("n", "p_n")).select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")).distinct()
            found = possible(pairs, bits)
        labels = connected(verified(found, sets), labels)
        if last:
            break
    return labels if labels is not None else sets.select("rep", F.col("rep").alias("label")).limit(0)
