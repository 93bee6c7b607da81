"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct five-word shingles; two documents link when
100 * |intersection| >= 75 * |union| (the threshold is a parameter). The join runs in these steps:

1. `_blocks` reads the texts once, names each shingle by a 52-bit hash and each set by a 128-bit signature,
   drops repeated sets inside a block and sends the shingles out by hash range, packed in binary.
2. `_shared` counts, per range, in how many sets each shingle is. A shingle in one set only can
   join nothing, so just the others go back to their block, with their counts.
3. `_prefixes` orders every set by (count, hash), rarest first. The shingles that only one set has
   come first and fill the prefix of most documents, which then have no partner and are done.
4. Sets with the same prefix and size collapse into one group. Groups that share a prefix shingle are candidates;
   pairs are filtered by size and by the position of the shingle.
5. Candidates are verified on the whole sets. Groups are first verified against one hub per prefix list,
   which joins large groups of copies without forming their pairs; then the groups are expanded to their members, and
   every candidate pair that the links so far do not connect is verified too.

So no link between different sets is lost for the components, though pairs that are connected anyway are not
formed. Components come from label propagation over the verified links; nothing is collected to the driver.

Defined results: a NULL, empty or wordless text has the empty set and links with nothing; a text of one to four
words has its whole sequence as one shingle; equal sets link; equal doc_ids keep their rows; a NULL doc_id is
carried and never chosen as component while another member has one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulake.llm.words import MASK_SPACE, chained, find_words, mix, pieces, text_offsets
from granulake.llm.workers import give_back, let_go
from granulake.session import cut, shuffle_partitions

_DOC_BITS = np.uint64(12)
_DOC_MASK = np.uint64(4095)
_WIDTH = 7  # bytes of a packed (hash, document) entry once the range's bits are left out
BLOCK_SCHEMA = "part int, block binary, doc_id bigint, local int, n bigint, cls binary, entries binary, counts binary"
_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.binary()), ("doc_id", pa.int64()), ("local", pa.int32()),
        ("n", pa.int64()), ("cls", pa.binary()), ("entries", pa.binary()), ("counts", pa.binary()),
    ]
)


def _batch(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _pack(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH])


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, _WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_WIDTH] = raw
    return out.reshape(-1).view("<u8")


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of up to 4096 texts as sorted numbers (hash, text number in the low bits), the size of each
    set, and two signatures of each set."""
    words = find_words(*text_offsets(column), MASK_SPACE)
    docs = len(column)
    counts = np.diff(words.first)
    doc = np.repeat(np.arange(docs), counts)
    hashes = chained(words.hashes, n)
    at = np.flatnonzero(doc[: len(hashes)] == doc[n - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    parts = [(hashes[at], doc[at])]
    for k in range(1, n):  # a short text is one shingle, unlike any longer one
        short = np.flatnonzero(counts == k)
        if len(short):
            first = words.first[short]
            parts.append((chained(words.hashes[first[:, None] + np.arange(k)].T, k)[0] ^ np.uint64(k << 20), short))
    values, owner = (np.concatenate(x) for x in zip(*parts))
    entries = np.sort((values & ~_DOC_MASK) | owner.astype(np.uint64))
    entries = entries[np.append(True, entries[1:] != entries[:-1])] if len(entries) else entries
    owner = (entries & _DOC_MASK).astype(np.uint16)
    sizes = np.bincount(owner, minlength=docs)
    tokens = (entries >> _DOC_BITS)[np.argsort(owner, kind="stable")]
    filled = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[filled]
    signs = np.zeros((2, docs), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(2 if len(filled) else 0):
            signs[i, filled] = np.add.reduceat(mix(tokens * np.uint64(2 * i + 1) + np.uint64(i * 977)), begins)
    return entries, sizes, signs[0], signs[1]


def _blocks(batches, n: int, bits: int) -> Iterator[pa.RecordBatch]:
    let_go()
    for big in pieces(batches, "text", 2 << 20):
        for begin in range(0, big.num_rows, 4096):
            batch = big.slice(begin, 4096)
            entries, sizes, a, b = shingle_sets(batch.column("text"), n)
            ids = batch.column("doc_id")
            signs = np.stack([a, b, sizes.astype(np.uint64)], axis=1)
            _, first = np.unique(signs, axis=0, return_index=True)
            chosen = np.zeros(len(sizes), bool)
            chosen[first] = True
            chosen &= sizes > 0
            cls = [x.tobytes() for x in signs[:, :2]]
            # named by its documents in their order: a repeated task names it alike, and a repeated block is the same
            place = np.arange(len(a), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            block = mix(np.array([(a * place).sum(), (b * place).sum() ^ np.uint64(len(a))])).tobytes()
            entries = entries[chosen[(entries & _DOC_MASK).astype(np.int64)]]
            part = (entries >> np.uint64(64 - bits)).astype(np.int64)
            edges = np.searchsorted(part, np.arange((1 << bits) + 1))
            packed = _pack(entries & np.uint64((1 << (64 - bits)) - 1))
            filled = np.flatnonzero(np.diff(edges))
            yield _batch(
                part=np.arange(len(sizes)) % (1 << bits), block=[block] * len(sizes), doc_id=ids.to_pylist(),
                local=[i if c else None for i, c in enumerate(chosen)], n=sizes, cls=cls,
            )
            for some in np.array_split(filled, max(1, len(packed) * _WIDTH // (8 << 20) + 1)):
                if len(some):
                    blobs = [packed[edges[p] : edges[p + 1]].tobytes() for p in some]
                    yield _batch(part=some, block=[block] * len(some), entries=blobs)
    give_back()


def _shared(rows: pa.Table, bits: int) -> pa.Table:
    """The documents as they are, and the entries whose shingle is in several sets, with the number of sets."""
    rows = rows.combine_chunks()
    docs = rows.filter(pc.is_null(rows["entries"]))
    sent = rows.filter(pc.is_valid(rows["entries"]))
    out = [docs.cast(_ARROW)]
    if sent.num_rows:
        top = np.uint64(sent["part"][0].as_py()) << np.uint64(64 - bits)
        blobs = [_unpack(x.as_py()) | top for x in sent["entries"]]
        owner = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
        entries = np.concatenate(blobs)
        hashes = entries >> _DOC_BITS
        order = np.argsort(hashes)
        ordered = hashes[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        runs = np.diff(np.append(first, len(ordered)))
        counts = np.empty(len(order), np.int64)
        counts[order] = np.repeat(runs, runs)
        keep = np.flatnonzero(counts > 1)
        edges = np.searchsorted(owner[keep], np.arange(len(blobs) + 1))
        entries, counts = entries[keep].astype("<u8"), np.minimum(counts[keep], 65535).astype("<u2")
        some = np.flatnonzero(np.diff(edges))
        block = sent["block"].to_pylist()
        out.append(
            pa.Table.from_batches(
                [
                    _batch(
                        block=[block[i] for i in some],
                        entries=[entries[edges[i] : edges[i + 1]].tobytes() for i in some],
                        counts=[counts[edges[i] : edges[i + 1]].tobytes() for i in some],
                    )
                ]
            )
        )
    return pa.concat_tables(out)


def _prefixes(rows: pa.Table, percent: int) -> pa.Table:
    """Per set of a block that may have a partner: its shared shingles in order, and how many are in its prefix."""
    rows = rows.combine_chunks()
    docs = rows.filter(pc.is_null(rows["entries"]))
    sent = rows.filter(pc.is_valid(rows["entries"]))
    cls, size, own, head, sets = [], [], [], [], []
    if docs.num_rows and sent.num_rows:
        entries = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in sent["entries"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in sent["counts"]])
        entries, once = np.unique(entries, return_index=True)
        owner, counts = (entries & _DOC_MASK).astype(np.int64), counts[once]
        hashes = (entries >> _DOC_BITS).astype(np.int64)
        order = np.lexsort((hashes, counts, owner))
        owner, hashes = owner[order], hashes[order]
        names = docs["cls"].to_pylist()
        for local, n, name in zip(docs["local"].to_pylist(), docs["n"].to_pylist(), names):
            low, high = np.searchsorted(owner, [local, local + 1])
            prefix = n - -(-n * percent // 100) + 1
            alone = n - (high - low)
            if prefix > alone:
                cls.append(name)
                size.append(n)
                own.append(alone)
                head.append(prefix - alone)
                sets.append(hashes[low:high])
    return pa.table(
        [
            pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.array(own, pa.int64()),
            pa.array(head, pa.int32()), pa.array(sets, pa.list_(pa.int64())),
        ],
        names=["cls", "n", "alone", "head", "tokens"],
    )


def _need(a: str, b: str, percent: int) -> str:
    """Smallest intersection that sets of these sizes need."""
    return f"ceil({percent} * ({a} + {b}) / {100 + percent})"


def _candidates(left: DataFrame, right: DataFrame, percent: int, extra: str) -> DataFrame:
    """Pairs that share a prefix shingle and may reach the threshold, judged by sizes and positions."""
    a, b = (
        d.select("token", *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c != "token"])
        for d, s in ((left, "a"), (right, "b"))
    )
    sized = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    placed = f"1 + least(n_a - at_a, n_b - at_b) >= {_need('n_a', 'n_b', percent)}"
    return a.join(b, "token").where(f"{sized} and {placed} and {extra}")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The different (comp_a, comp_b) with a pair (cls_a, cls_b) that links, judged on the whole sets."""
    a, b = (sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "tokens")]) for s in "ab")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return (
        pairs.join(a, "cls_a").join(b, "cls_b")
        .where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))
        .select("comp_a", "comp_b").distinct()
    )


def components(links: DataFrame, a: str = "comp_a", b: str = "comp_b") -> DataFrame:
    """(node, label) of every node of the links; a label is the smallest node that links reach.

    Each round a node takes the smallest label around it and then its label's own label, so long chains
    shrink by jumps. Labels go to the shared folder each round.
    """
    ways = [links.select(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ((a, b), (b, a))]
    edges = cut(ways[0].union(ways[1]).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = step.join(jump, "low", "left").select("node", "label", F.least("low", "far").alias("next"))
        after = cut(after, "labels")
        done = not after.where("next <> label").limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if done:
            return labels


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes (cls, comp) with the components that links between components give."""
    named = components(cut(links, "links")).select(F.col("node").alias("comp"), "label")
    return cut(nodes.join(named, "comp", "left").select("cls", F.coalesce("label", "comp").alias("comp")), "nodes")


def _open(lists: DataFrame) -> DataFrame:
    """The lists whose members are not all connected yet."""
    opened = lists.groupBy("token").agg((F.min("comp") != F.max("comp")).alias("open")).where("open").select("token")
    return cut(lists.join(opened, "token"), "open")


def _hubs(lists: DataFrame, percent: int) -> DataFrame:
    """Each set with the one hub, of all lists of its prefix, that it shares most prefix shingles with."""
    first = F.min_by(F.struct("cls", "n", "at", "comp"), F.struct(F.xxhash64("cls"), "cls"))
    hub = lists.groupBy("token").agg(first.alias("hub"), F.count("*").alias("members"))
    hub = hub.where("members > 1").select("token", "hub.*")
    pairs = _candidates(lists, hub, percent, "comp_a <> comp_b").groupBy("cls_a", "comp_a", "cls_b", "comp_b").count()
    most = F.max_by(F.struct("cls_b", "comp_b"), F.struct("count", "cls_b"))
    return pairs.groupBy("cls_a", "comp_a").agg(most.alias("hub")).select("cls_a", "comp_a", "hub.*")


def _drawn(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each set with the members of its lists that `4 * turn` draws a list take, so that a set meets several members of
    a large component without meeting all."""
    member = F.struct("cls", "n", "at", "comp")
    by = [F.struct(F.xxhash64("cls", "token", F.lit(turn), F.lit(i)), "cls") for i in range(4 * turn)]
    drawn = lists.groupBy("token").agg(F.array_distinct(F.array(*[F.min_by(member, b) for b in by])).alias("hubs"))
    hubs = drawn.select("token", F.explode("hubs").alias("hub")).select("token", "hub.*")
    pairs = _candidates(lists, hubs, percent, "comp_a <> comp_b")
    return pairs.select("cls_a", "comp_a", "cls_b", "comp_b").distinct()


def jaccard_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, turns: int = 4
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    spark = docs.sparkSession
    bits = max(8, (shuffle_partitions(spark) - 1).bit_length())
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sent = texts.mapInArrow(lambda rows: _blocks(rows, n, bits), BLOCK_SCHEMA)
    back = cut(sent.groupBy("part").applyInArrow(lambda rows: _shared(rows, bits), BLOCK_SCHEMA), "shared")
    rows = back.where("entries is null").select("doc_id", "n", "cls", "block", "local")
    # one place of each set, whichever block holds it
    chosen = rows.where("local is not null").groupBy("cls").agg(F.min(F.struct("block", "local", "n")).alias("at"))
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("entries", "counts")]
    asked = chosen.select("at.block", "at.local", "at.n", "cls", *nothing)
    given = back.where("entries is not null").select("block", "local", "n", "cls", "entries", "counts")
    schema = "cls binary, n bigint, alone bigint, head int, tokens array<bigint>"
    sets = cut(asked.union(given).groupBy("block").applyInArrow(lambda r: _prefixes(r, percent), schema), "sets")

    # groups: the same prefix and size; a shingle of its own makes a prefix unlike all others
    prefix = F.slice("tokens", F.lit(1), F.col("head"))
    named = F.sha2(F.concat_ws(":", "n", F.array_join(prefix, ",")), 256)
    same = F.when(F.col("alone") == 0, named).otherwise(F.hex("cls"))
    members = sets.select("cls", "n", same.alias("same"))
    least = members.groupBy("same").agg(F.min("cls").alias("grp"))
    grouped = cut(members.join(least, "same").select("cls", "grp"), "groups")
    postings = sets.select("cls", "n", "alone", F.posexplode(prefix).alias("i", "token"))
    postings = postings.select("cls", "n", "token", (F.col("alone") + F.col("i") + 1).alias("at"))
    heads = grouped.where("cls = grp").select("cls")
    lists = postings.join(heads, "cls", "left_semi").withColumn("comp", F.col("cls"))

    # hubs first; then, member by member, more and more hubs of the lists still open; then every pair left
    names = {"cls_a": "cls", "comp_a": "cls", "cls_b": "grp", "comp_b": "grp"}
    inside = grouped.where("cls <> grp").select(*[F.col(c).alias(name) for name, c in names.items()])
    nodes = grouped.select("cls", F.col("cls").alias("comp"))
    nodes = _joined(nodes, _verified(_hubs(lists, percent).union(inside), sets, percent))
    rest = _open(postings.join(nodes, "cls"))
    for turn in range(1, turns + 1):
        nodes = _joined(nodes, _verified(_drawn(rest, percent, turn), sets, percent))
        rest = _open(rest.drop("comp").join(nodes, "cls"))
    pairs = _candidates(rest, rest, percent, "comp_a < comp_b").select(*names).distinct()
    nodes = _joined(nodes, _verified(pairs, sets, percent))
    nodes = rows.select("doc_id", "n", "cls").join(nodes, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = nodes.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    full = nodes.where("n > 0").join(least, "comp").select("doc_id", "n", "least")
    empty = nodes.where("n = 0").select("doc_id", "n", "doc_id")
    return full.union(empty).toDF("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose doc_id is the smallest of their component, in their own columns.

    Rows that are equal in doc_id and text count once; rows without a doc_id, which no component can name, stay.
    """
    found = jaccard_components(docs, doc_id=doc_id, text=text, **options)
    chosen = found.where("doc_id = component_id").select("doc_id").distinct()
    key = F.col(f"`{doc_id}`").cast("bigint")
    row, digest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(F.col(f"`{text}`"))
    rows = docs.select(row.alias("row"), key.alias("doc_id"), digest.alias("digest"))
    named = rows.where("doc_id is not null").join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id", "digest"])
    return named.select("row.*").union(rows.where("doc_id is null").select("row.*"))
