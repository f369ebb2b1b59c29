"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Two fingerprints that differ in ``radius`` bits at most agree in some table for certain, not just
with high probability. Give each bit position a non-zero vector of ``radius + 1`` bits; the table
of a non-zero vector v compares the positions whose vectors have an odd number of bits in common
with v. The vectors of the differing positions span less than the whole space, so some v is
orthogonal to all of them, and its table sees none of the differences (Pagh, 2016).

``near_duplicates`` groups documents by their fingerprints; ``keep_one`` takes such groups as candidates
and compares the texts in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.graph import connected_components, hinted, links_inside
from lakeloom.llm.shared import counted, fresh, known, seen, text_batches, written

BITS = 64
#: Tables in the first step, over all fingerprints of an item; each later step takes eight times as many.
FIRST = 4
#: Words of a bucket, and texts of a candidate group, that one task compares at most, but for those that it is dealt from another slice.
MIDDLE, TEXTS = 4096, 256
#: Buckets (8 bytes each) that are broadcast at most to look up their words.
BUCKETS = 1_000_000


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int) -> list[int]:
    """One mask of about half the bits for each of the ``2**(radius + 1) - 1`` tables.

    Below radius 6 the bit positions share all non-zero vectors out evenly. At radius 6 there are more
    vectors than positions; those with the highest bit set give every mask 32 bits (or all 64), as in a first-order
    Reed-Muller code.
    """
    if not 0 <= radius <= 6:
        raise ValueError("a radius from 0 to 6 bits is covered")
    n = (1 << (radius + 1)) - 1
    vector = [64 + i if radius == 6 else i % n + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def fingerprint(text: str | None, words: int = 4, repeats: bool = True, seed: int = 42) -> int:
    """A 64-bit SimHash of the text's shingles: a bit is set if it is in over half the hashes.

    Without ``repeats`` each different shingle counts once.

    Words are runs of characters other than blank and U+0009 to U+000D, A to Z lower-cased. A text
    of fewer words than a shingle is one shingle; a text without words has fingerprint zero.
    """
    import numpy as np
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if not repeats:
        return _majority(list({b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}), seed)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(parts))
    n = len(parts) - k + 1
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # a very long text needs no more memory than this many hashes
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], dtype="<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def _majority(shingles: list[bytes], seed: int) -> int:
    import numpy as np
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(x, seed) for x in shingles], dtype="<u8")
    set_bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, repeats: bool = True) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for b in text_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_signed(fingerprint(t, words, repeats)) for t in b.column("text").to_pylist()], type=pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _within(radius: int):
    """Which rows of a table have a word ``fp`` within ``radius`` bits of a row's."""

    def near(table):
        import numpy as np

        fp = table.column("fp").to_numpy().view("<u8")
        return lambda i: np.bitwise_count(fp ^ fp[i]) <= radius

    return near


def near_components(items: DataFrame, prints: list[str], radius: int = 4, middle: int = MIDDLE) -> DataFrame:
    """Components (node, root) of items of which a fingerprint, the same of ``prints``, differs by ``radius`` bits at most.

    ``items`` has different longs in ``node`` and a word in each column of ``prints``. A root is the smallest node of its component
    and has no row. Tables are taken in steps of growing size. After each the links found so far are contracted,
    and the next one looks at no bucket whose items hang together already, so a large family of near words costs a few
    links for each item, not one for each table. One aggregate over the tables of a step counts each bucket and keeps
    its smallest and largest word and root. Buckets of two are those two; the items of larger ones are looked up again and
    compared by ``links_inside``.

    A bucket is a 64-bit hash of table and key; two that share a hash only add pairs that are compared.
    """
    masks = covering_masks(radius)
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labelled = items.select("node", *prints, F.col("node").alias("root"))
    done, step, rows = 0, max(1, FIRST // len(prints)), 0
    while done < len(masks):
        tables = list(enumerate(masks))[done : done + step]
        done, step = done + step, step * 8
        buckets = F.array(*[F.xxhash64(F.lit(p), F.lit(v), F.col(p).bitwiseAND(F.lit(_signed(m)))) for p in prints for v, m in tables])
        word = F.element_at(F.array(*prints), (F.col("_at") / len(tables)).cast("int") + 1)
        # The items may lie in one file; their buckets are many.
        keys = labelled.repartition(parts, "node").select("root", *prints, F.posexplode(buckets).alias("_at", "group")).select("group", "root", word.alias("fp"))
        found = keys.groupBy("group").agg(F.count("*").alias("n"), F.min("fp").alias("p"), F.max("fp").alias("q"), F.min("root").alias("a"), F.max("root").alias("b"))
        found = counted(found.where("a < b"), "buckets", larger=F.col("n") > 2)
        if not seen(found):
            continue
        links = found.where(f"n = 2 and bit_count(p ^ q) <= {radius}").select("a", "b")
        if seen(found, "larger"):
            larger = known(found.where("n > 2").select("group"), rows=seen(found, "larger"))
            members = written(keys.join(hinted(larger, BUCKETS), "group").select("group", F.col("root").alias("node"), "fp").distinct(), "members")
            links = links.unionByName(links_inside(members, _within(radius), middle))
        roots = connected_components(links)
        if not seen(roots):
            continue
        joined = labelled.join(hinted(roots).select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("root") == F.col("_node"), "left")
        labelled = counted(joined.select("node", *prints, F.coalesce("_root", "root").alias("root")), "labelled", joined=F.col("node") != F.col("root"))
        rows = seen(labelled, "joined")
    return known(labelled.where("node <> root").select("node", "root"), rows=rows)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, repeats: bool = True) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links lead to.

    Documents with one fingerprint are one node of the graph, however many they are. Null texts
    have fingerprint zero, as those without words. Rows with null doc_ids keep their row and count
    as no smallest id; a component of such rows alone has a null component_id. Repeated rows keep
    their rows. An empty table gives no rows. Columns other than doc_id and text are left out.
    """
    fps = written(fingerprints(docs, words, repeats), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = near_components(nodes.select(F.col("fp").alias("node"), "fp"), ["fp"], radius)
    rooted = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(firsts, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = 5):
    """The different shingles of a text as sorted 64-bit hashes (signed); words and short texts as in ``fingerprint``."""
    import numpy as np
    import xxhash

    parts = (text or "").encode().lower().split()
    k = min(words, len(parts))
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + k]), 42) for i in range(len(parts) - k + 1)] if parts else []
    return np.unique(np.array(hashes, dtype="<u8").view(np.int64))


def _profiles(docs: DataFrame, words: int, repeats: bool, shingle: int, prints: list[str]) -> DataFrame:
    """doc_id, ``th`` (a hash of the text), ``key`` (16 bytes that tell the set of shingles) and fingerprints of each row."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in text_batches(batches):
            texts = b.column("text").to_pylist()
            keys = [xxhash.xxh128_digest(shingle_set(t, shingle).tobytes()) for t in texts]
            fps = [pa.array([_signed(fingerprint(t, words, repeats, 42 + k)) for t in texts], type=pa.int64()) for k in range(len(prints))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(keys, type=pa.binary()), *fps], names=["doc_id", "th", "key", *prints])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, key binary" + "".join(f", {p} long" for p in prints))


def _alike(similarity: float):
    """Which rows of a table have a set ``s`` whose Jaccard similarity to a row's is at least this."""

    def near(table):
        import numpy as np

        sets = table.column("s").combine_chunks()
        ends = sets.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(ends)
        codes = np.unique(sets.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)[1]
        ends = ends - ends[0]
        of_row = np.repeat(np.arange(len(sizes)), sizes)

        def of(i: int):
            own = np.zeros(int(codes.max(initial=-1)) + 1, dtype=bool)
            own[codes[ends[i] : ends[i + 1]]] = True
            both = np.bincount(of_row, weights=own[codes], minlength=len(sizes))
            every = sizes + sizes[i] - both
            # Two empty sets are alike.
            return both >= similarity * every

        return of

    return near


#: Shingles of large groups that are counted to tell frequent ones; the order they decide is for balance only.
SAMPLED = 1_000_000
#: Places of prefixes that are joined in each step, up to the last of all.
STEPS = (1, 2, 4, 8, 16)


def _frequent(sets: DataFrame) -> dict[int, int]:
    """Shingles that a bounded sample of the sets holds three times or more, with their counts."""
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(max(1, -(-total // SAMPLED)))) == 0)
    return dict(map(tuple, some.select(F.explode("s").alias("x")).groupBy("x").count().where("count > 2").collect()))


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """group, node, ``at``, ``token``, ``n`` and ``short`` of each set's prefix: two sets alike by ``similarity`` share a token of their prefixes.

    Of n shingles in one order for all sets, rarer ones first, the prefix is the first n - ceil(similarity * n) + 1. Alike sets share at
    least 2 * similarity / (1 + similarity) of the smaller one's shingles, so they even share a token that is in the smaller one's
    shorter prefix by that measure (``short``).
    """
    counts = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = counts.value
        tokens = np.array(sorted(known), dtype=np.int64)
        often = np.array([known[t] for t in tokens.tolist()], dtype=np.int64)
        for b in batches:
            out, short = [], []
            for s in b.column("s").to_pylist():
                s = np.array(s, dtype=np.int64)
                n = np.zeros(len(s), dtype=np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    n = np.where(tokens[at] == s, often[at], 0)
                out.append(s[np.lexsort((s, n))][: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1])
                short.append(np.arange(len(out[-1])) < len(s) - math.ceil(2 * similarity / (1 + similarity) * len(s) - 1e-9) + 1)
            sizes = [len(x) for x in out]
            take = pa.array(np.repeat(np.arange(len(out)), sizes))
            column = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
            n = pc.list_value_length(b.column("s")).take(take).cast(pa.int32())
            places = [column([np.arange(k) for k in sizes], pa.int32()), column(out, pa.int64()), n, column(short, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("group").take(take), b.column("node").take(take), *places], names=["group", "node", "at", "token", "n", "short"])

    return sets.select("group", "node", "s").mapInArrow(run, "group long, node long, at int, token long, n int, short boolean")


def similar_links(sets: DataFrame, similarity: float, texts: int = TEXTS) -> DataFrame:
    """Links (a, b) that join up just what chains of alike sets join, of ``sets`` (group, node, s) inside each group.

    Groups of up to ``texts`` sets are compared in one task. In larger ones only sets that share a token of their prefixes are compared,
    bucket by bucket of tokens, so the work follows what sets have in common and not the square of the group. Tokens are taken in steps from the rarest on; after
    each what was found is contracted, and buckets that hang together already, or got no set since they were compared, are not looked at again.
    A set that holds the token outside its short prefix is compared only if a set no larger holds it inside: any alike pair meets so in some bucket.
    A bucket is a 64-bit hash of group and token; two that share a hash only add comparisons.
    """
    large = counted(sets.groupBy("group").count().where(F.col("count") > texts).select("group"), "large-candidates")
    if not seen(large):
        return links_inside(sets, _alike(similarity), texts)
    links = links_inside(sets.join(hinted(large), "group", "left_anti"), _alike(similarity), texts)
    sets = written(sets.join(hinted(large), "group", "left_semi"), "large-sets")
    tokens = written(prefixes(sets, similarity).select("node", "at", "n", "short", F.xxhash64("group", "token").alias("group")), "prefixes")
    begin, labelled = 0, sets.select("node", F.col("node").alias("root"))
    for end in (*STEPS, None):
        keys = (tokens if end is None else tokens.where(F.col("at") < end)).join(labelled, "node").select("group", "node", "root", "at", "n", "short")
        open_ = keys.groupBy("group").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("at").alias("last"), F.min(F.when(F.col("short"), F.col("n"))).alias("least"))
        open_ = counted(open_.where((F.col("a") < F.col("b")) & (F.col("last") >= begin) & F.col("least").isNotNull()).select("group", "least"), "token-buckets")
        begin = end
        if not seen(open_):
            continue
        held = keys.join(hinted(open_, BUCKETS), "group").where("short or n >= least").select("group", "node", "root").distinct()
        members = written(held.join(sets.select("node", "s"), "node").select("group", F.col("root").alias("node"), "s"), "token-members")
        found = connected_components(links_inside(members, _alike(similarity), texts))
        if not seen(found):
            continue
        labelled = written(labelled.join(hinted(found).select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root")), "labelled")
    return links.unionByName(labelled.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))


def keep_one(docs: DataFrame, words: int = 1, radius: int = 6, repeats: bool = False, shingle: int = 5, similarity: float = 0.8, prints: int = 2, texts: int = TEXTS) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id.

    Candidates are the components of documents of which one of ``prints`` fingerprints, made with different seeds, differs
    within ``radius`` bits. Fingerprints are of the set of words: of two texts whose shingles are alike, words differ less
    than shingles do. Inside a component texts are linked if the Jaccard similarity of their sets of five-word shingles is at
    least ``similarity``; groups are what links join. Texts of one set of shingles are one node, however many they are;
    up to ``texts`` nodes of a component are compared in one task, in larger ones those that share a shingle of their prefixes (``similar_links``).

    Rows with null doc_ids stay and are no reason for others to go. Null texts count as texts without words, which
    are all alike. Rows that repeat doc_id and text count once; rows that share a doc_id only are documents of their own.
    Empty tables give no rows; other columns stay as they are.
    """
    th, gone_id, gone_th = (fresh(n, docs) for n in ("_text_of_near", "_gone_id", "_gone_th"))
    names = [f"p{k}" for k in range(prints)]
    profiles = written(_profiles(docs.where("doc_id is not null"), words, repeats, shingle, names), "profiles")
    nodes = profiles.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("rep"), *[F.min(p).alias(p) for p in names])
    nodes = written(nodes.select("key", "rep.doc_id", "rep.th", *names, F.monotonically_increasing_id().alias("node")), "nodes")  # numbers stay as they were written
    roots = near_components(nodes.select("node", *names), names, radius)
    rooted = written(nodes.select("node", "doc_id", F.col("th").alias(th)).join(hinted(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    several = known(roots.select("root").distinct(), rows=seen(roots))  # at most
    asked = counted(rooted.join(hinted(several), "root", "left_semi").withColumnRenamed("doc_id", "id"), "candidates")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias(th), "text").join(hinted(asked), ["id", th]).select("root", "node", "text")

    def run(batches):
        import pyarrow as pa

        for b in text_batches(batches):
            sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), pa.array(sets, type=pa.list_(pa.int64()))], names=["group", "node", "s"])

    sets = written(rows.mapInArrow(run, "group long, node long, s array<long>").dropDuplicates(["node"]), "shingle-sets")
    groups = connected_components(similar_links(sets, similarity, texts))
    joined = written(nodes.select("key", "doc_id", "th", "node").join(hinted(groups).select("node", F.col("root").alias("top")), "node", "left").withColumn("top", F.coalesce("top", "node")), "joined")
    kept = joined.groupBy("top").agg(F.min(F.struct("doc_id", "th")).alias("kept"))
    tops = joined.join(kept, "top").select("key", F.col("kept.doc_id").alias("kept_id"), F.col("kept.th").alias("kept_th"))
    gone = counted(profiles.join(tops, "key").where("doc_id <> kept_id or th <> kept_th").select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)).distinct(), "gone")
    twice = counted(profiles.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", F.col("th").alias(th)), "repeated")
    rows = docs.withColumn(th, F.xxhash64("text"))
    left = rows.join(hinted(gone), (F.col("doc_id") == F.col(gone_id)) & (F.col(th) == F.col(gone_th)), "left_anti")
    if not seen(twice):
        return left.select(docs.columns)
    once = left.join(twice, ["doc_id", th], "left_semi").dropDuplicates(["doc_id", th])
    return left.join(twice, ["doc_id", th], "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
