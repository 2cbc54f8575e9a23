"""Exact join of documents whose sets of word n-grams have a Jaccard similarity of ``percent`` or more.

Method: a token-group matrix. Similar documents are partitioned into groups, each group keeps the union
of its members' tokens, a query document's overlap with that union bounds its overlap with every member,
and only groups whose bound suffices are opened.

How it is spread over a cluster:

1. Documents of the same set are one class (a 128-bit digest of the sorted set), so copies, however many, are one
   row of everything that follows.
2. Candidates, without a loss. Document frequencies of all n-grams are counted, by bucket of n-gram. A linked document shares at least
   a share ``t`` of its ``n`` n-grams with one other, so a document with fewer that anyone else has is linked with
   nothing and is done. Of the others' n-grams, ordered by frequency (rare first), the first ``n - ceil(t * n) + 1`` hold one
   that a linked document has among its own first ones. A phrase that very many documents share comes last in
   that order, so it makes no candidates by itself.
3. Equal n-grams among those are linked with their smallest class; the connected components of these candidate links
   are the neighbourhoods: every true link lies inside one.
4. Each neighbourhood is joined exactly by the token-group matrix. A neighbourhood of more than ``block`` classes is
   dealt out as pairs of blocks of compatible size levels, so no task holds an unbounded group.
5. Links found are connected components again; a block emits a spanning forest, never all pairs.

Nothing is capped or sampled. Hashes of n-grams have 64 bits; within one pair of documents two n-grams
are mixed up with a probability of about size**2 / 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.llm import arrays as A
from deltatree.llm.graph import components
from deltatree.session import cut_lineage

#: Classes of a neighbourhood that one task compares, and n-grams that they have together, about; beyond, pairs of blocks of this size.
BLOCK, BLOCK_GRAMS = 2048, 4_000_000
#: N-grams that one bucket holds, about.
BUCKET = 2_000_000
#: A side of a join is broadcast up to so many rows; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Members of a group in the token-group matrix.
GROUP = 32


def _sets(batch: pa.RecordBatch, column: str, k: int, table: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every row."""
    text, at = A.text_bytes(batch.column(column))
    data = np.frombuffer(text.translate(A.LOWER), np.uint8)
    starts, ends, words = A.word_spans(data, at, table)
    grams, of = A.windows(A.span_hashes(data, starts, ends), words, k)
    out = []
    for d in range(len(at) - 1):
        s = np.sort(grams[of[d]:of[d + 1]])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if s.size > 1 else s)
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else b""


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def document_sets(docs: DataFrame, k: int, table: np.ndarray = A.SPACED) -> DataFrame:
    """Rows ``(doc_id, mark, n_shingles, digest, node)``, one per document; ``mark`` hashes the text, an empty set has an empty digest."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                sets = _sets(part, "text", k, table)
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("mark"), pa.array([s.size for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([_node(d) for d in digests], pa.int64())], ["doc_id", "mark", "n_shingles", "digest", "node"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(
        run, "doc_id long, mark long, n_shingles long, digest binary, node long")


def _cuts(keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys in use and the places where each begins, of sorted keys below ``count``."""
    cut = np.searchsorted(keys, np.arange(count + 1))
    return np.flatnonzero(np.diff(cut)), cut


def _blobs(data: np.ndarray, used: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.array([data[cut[i]:cut[i + 1]].tobytes() for i in used], pa.binary())


def _joined(blobs: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _spread(values: np.ndarray, count: int) -> np.ndarray:
    """Numbers below ``count`` for 64-bit values, in the order of the values."""
    return (((values >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Places where any of the keys changes, the first one included."""
    changed = np.zeros(keys[0].size, bool)
    changed[:1] = True
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where equal keys begin, again after 65,535 of them, and how many follow, as 16-bit numbers."""
    first = _starts(*keys)
    n = np.diff(np.append(first, keys[0].size))
    if n.size and n.max() > 65535:
        parts = -(-n // 65535)
        first = np.repeat(first, parts) + 65535 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        n = np.diff(np.append(first, keys[0].size))
    return first, n.astype(np.uint16)


def candidate_links(docs: DataFrame, k: int, percent: int, buckets: int, table: np.ndarray = A.SPACED) -> DataFrame:
    """Rows ``(a, b)``: classes that share one of their rarest n-grams, each with the smallest one that has it.

    N-grams travel packed, grouped by document: one row for each slice of text and bucket; a row of Spark for
    each of them would cost several times the work.
    """
    names = ["bucket", "grams", "nodes", "counts", "needed"]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, most=2 * A.SLICE_BYTES):
                classes = {d: s for s in _sets(part, "text", k, table) if (d := _digest(s))}
                if not classes:
                    continue
                n = np.array([s.size for s in classes.values()])
                node = np.array([_node(d) for d in classes], np.int64)
                gram, owner = np.concatenate(list(classes.values())), np.repeat(np.arange(n.size), n)
                bucket, low = _spread(gram, buckets), gram.astype(np.uint32)
                order = np.lexsort((low, owner, bucket))
                order = order[_starts(bucket[order], owner[order], low[order])]  # n-grams are known by bucket and 32 bits from here on
                bucket, owner, low = bucket[order], owner[order], low[order]
                first, counts = _groups(bucket, owner)
                size = np.bincount(owner, minlength=n.size)
                # n-grams that are compared, and distinct ones
                needed = np.stack([n - -(-percent * n // 100) + 1, size], 1).astype(np.uint32)
                used, cut = _cuts(bucket, buckets)
                _, group = _cuts(bucket[first], buckets)
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), _blobs(low, used, cut), _blobs(node[owner[first]], used, group), _blobs(counts, used, group),
                    pa.nulls(used.size, pa.binary())], names)
                # these numbers go to where the class's n-grams will meet
                target = _spread(A.mix(node.view(np.uint64)), buckets)
                order = np.argsort(target, kind="stable")
                used, cut = _cuts(target[order], buckets)
                none = pa.array([b""] * used.size, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), none, _blobs(node[order], used, cut), none, _blobs(needed[order], used, cut)], names)

    out = ["target", "bucket", "grams", "ranks", "nodes", "counts", "needed"]

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What more than one class has, sorted out by class: its bucket, frequency and 32 bits."""
        for bucket, cols in runs(batches, "bucket", ("grams", "nodes", "counts", "needed")):
            told = [i for i, x in enumerate(cols["needed"]) if x is not None]
            if told:
                yield pa.RecordBatch.from_arrays([
                    pa.array([bucket], pa.int32()), pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()),
                    pa.array([b"".join(cols["nodes"][i] for i in told)], pa.binary()), pa.array([b""], pa.binary()),
                    pa.array([b"".join(cols["needed"][i] for i in told)], pa.binary())], out)
            held = [x for x, y in zip(cols["nodes"], cols["needed"], strict=True) if y is None]
            names, back = np.unique(_joined(held, np.int64), return_inverse=True)
            key = np.sort((_joined(cols["grams"], np.uint32).astype(np.uint64) << np.uint64(32)) | np.repeat(
                back, _joined(cols["counts"], np.uint16)).astype(np.uint64))
            key = key[_starts(key)]  # a class that several slices hold
            first = _starts(key >> np.uint64(32))
            frequency = np.diff(np.append(first, key.size))
            frequency = np.repeat(frequency, frequency)
            key, frequency = key[frequency > 1], frequency[frequency > 1]
            if not key.size:
                continue
            owner, gram = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.uint32)
            rank = np.floor(4 * np.log2(frequency)).astype(np.uint8)
            target = _spread(A.mix(names.view(np.uint64)), buckets)[owner]
            order = np.lexsort((owner, target))
            owner, gram, rank, target = owner[order], gram[order], rank[order], target[order]
            first, counts = _groups(target, owner)
            used, cut = _cuts(target, buckets)
            _, group = _cuts(target[first], buckets)
            yield pa.RecordBatch.from_arrays([
                pa.array(used, pa.int32()), pa.array(np.full(used.size, bucket), pa.int32()), _blobs(gram, used, cut), _blobs(rank, used, cut),
                _blobs(names[owner[first]], used, group), _blobs(counts, used, group), pa.nulls(used.size, pa.binary())], out)

    def rarest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first n-grams of every class that enough of them are shared of."""
        for _, cols in runs(batches, "target", ("bucket", "grams", "ranks", "nodes", "counts", "needed")):
            told = [x is not None for x in cols["needed"]]
            names, index = np.unique(_joined([x for x, y in zip(cols["nodes"], told, strict=True) if y], np.int64), return_index=True)
            needed = _joined([x for x in cols["needed"] if x is not None], np.uint32).reshape(-1, 2)[index].astype(np.int64)
            # every class that shares an n-gram has told its numbers
            back = np.searchsorted(names, _joined([x for x, y in zip(cols["nodes"], told, strict=True) if not y], np.int64))
            owner = np.repeat(back, _joined(cols["counts"], np.uint16))
            gram = _joined(cols["grams"], np.uint32).astype(np.uint64) | (np.repeat(
                np.array(cols["bucket"], np.int64).astype(np.uint64), [len(g) // 4 for g in cols["grams"]]) << np.uint64(32))
            take = needed[:, 0] - (needed[:, 1] - np.bincount(owner, minlength=names.size))  # n-grams of its own come before all others
            able = take[owner] > 0
            owner, gram, rank = owner[able], A.mix(gram[able]), _joined(cols["ranks"], np.uint8)[able]
            order = np.lexsort((gram, rank, owner))
            owner, gram = owner[order], gram[order]
            first = _starts(owner)
            at = np.arange(owner.size) - np.repeat(first, np.diff(np.append(first, owner.size)))
            owner, gram = owner[at < take[owner]], gram[at < take[owner]]
            bucket = _spread(gram, buckets)
            order = np.argsort(bucket, kind="stable")
            used, cut = _cuts(bucket[order], buckets)
            if used.size:
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), _blobs(gram[order], used, cut), _blobs(names[owner[order]], used, cut)],
                                                 ["bucket", "grams", "nodes"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in runs(batches, "bucket", ("grams", "nodes")):
            gram, node = _joined(cols["grams"], np.uint64), _joined(cols["nodes"], np.int64)
            order = np.lexsort((node, gram))
            gram, node = gram[order], node[order]
            first = _starts(gram)
            leader = np.repeat(node[first], np.diff(np.append(first, gram.size)))
            pairs = np.unique(np.stack([node, leader], 1)[leader != node], axis=0)
            if pairs.size:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    def by(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(key).sortWithinPartitions(key)

    packed = docs.select("text").mapInArrow(emit, "bucket int, grams binary, nodes binary, counts binary, needed binary")
    found = by(packed, "bucket").mapInArrow(shared, "target int, bucket int, grams binary, ranks binary, nodes binary, counts binary, needed binary")
    first = by(found, "target").mapInArrow(rarest, "bucket int, grams binary, nodes binary")
    return by(first, "bucket").mapInArrow(meet, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """``df``, which is read from a written table, marked for a broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def distinct_runs(batches: Iterable[pa.RecordBatch], key: str, name: str, value: str) -> Iterator[tuple[object, dict[str, list]]]:
    """As ``runs`` for a stream that is sorted by ``key``, ``name`` and ``value``: of equal rows only one is held."""
    def once() -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            heads = list(zip(batch.column(key).to_pylist(), batch.column(name).to_pylist(), strict=True))
            values = batch.column(value)
            keep = []
            for i, head in enumerate(heads):
                # values are long texts: looked at where the rest is equal
                if head != last or values[i] != held:
                    keep.append(i)
                last, held = head, values[i]
            yield batch if len(keep) == len(heads) else batch.take(pa.array(keep, pa.int64()))

    yield from runs(once(), key, (value, name))


def runs(batches: Iterable[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[object, dict[str, list]]]:
    """Rows of equal ``key`` together, of a stream that is sorted by it."""
    now, held = None, {c: [] for c in columns}
    for batch in batches:
        keys = batch.column(key).to_pylist()
        values = {c: batch.column(c).to_pylist() for c in columns}
        begin = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[begin]:
                continue
            if keys[begin] != now:
                if now is not None:
                    yield now, held
                now, held = keys[begin], {c: [] for c in columns}
            for c in columns:
                held[c] += values[c][begin:i]
            begin = i
    if now is not None:
        yield now, held


def links_within(sets: list[np.ndarray], percent: int, group: int = GROUP) -> np.ndarray:
    """The component (an index of ``sets``) of every set, over all pairs that reach the threshold.

    The token-group matrix: sets are ordered by their smallest shared token, so that similar ones meet in a group;
    ``union`` marks the tokens of a group, and ``bound`` is each set's overlap with it. A group is opened only
    to sets for which overlap = bound would reach the threshold with its smallest possible member.
    """
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([s.size for s in sets], np.int64)
    if n < 2:
        return label
    tokens, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[index] > 1  # tokens of one set only are in no intersection
    rename = np.cumsum(count > 1) - 1
    ids = rename[index[shared]]
    owner = np.repeat(np.arange(n), sizes)[shared]
    at = np.searchsorted(owner, np.arange(n + 1))
    width = int((count > 1).sum())
    if not width:
        return label
    held = np.diff(at)
    lowest = np.full(n, width)
    mixed = A.mix(np.arange(width, dtype=np.uint64) + np.uint64(1))
    rank = np.argsort(np.argsort(mixed))
    lowest[held > 0] = np.minimum.reduceat(rank[ids], at[:-1][held > 0]) if ids.size else width
    order = np.lexsort((sizes, lowest))

    def overlaps(mark: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Marked tokens of each row."""
        lengths = held[rows]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(at[rows], lengths)
        total = np.concatenate([[0], np.cumsum(mark[ids[take]], dtype=np.int64)])
        return total[ends] - total[ends - lengths]

    every = np.flatnonzero(held)
    mark = np.zeros(width, np.uint8)
    for g in range(0, n, group):
        members = order[g:g + group]
        members = members[held[members] > 0]
        if not members.size or not every.size:
            continue
        union = np.zeros(width, np.uint8)
        for m in members:
            union[ids[at[m]:at[m + 1]]] = 1
        bound = overlaps(union, every)
        small, large = sizes[members].min(), sizes[members].max()
        q = sizes[every]
        # intersection <= min(bound, large), and the union of the pair is at least the larger of the two sets
        able = (100 * np.minimum(bound, large) >= percent * np.maximum(q, small)) & (100 * q >= percent * small) & (100 * large >= percent * q)
        opened = every[able]
        for m in members:
            rows = opened[(label[opened] != label[m]) & (100 * np.minimum(sizes[opened], sizes[m]) >= percent * np.maximum(sizes[opened], sizes[m]))]
            if not rows.size:
                continue
            mine = ids[at[m]:at[m + 1]]
            mark[mine] = 1
            both = overlaps(mark, rows)
            mark[mine] = 0
            linked = rows[100 * both >= percent * (sizes[rows] + sizes[m] - both)]
            if linked.size:
                joined = np.unique(np.append(label[linked], label[m]))
                label[np.isin(label, joined)] = joined[0]
    return label


def _tasks(members: DataFrame, percent: int, block: int) -> DataFrame:
    """``members`` once for each task that has to see them: column ``task``.

    A neighbourhood of up to ``block`` classes with up to ``BLOCK_GRAMS`` n-grams together is one task. A larger one is cut into blocks by size
    level and hash, and a task is a pair of blocks of one level or of two adjacent ones.
    """
    # Sizes that may be linked differ by a factor of 100 / percent at most; a little more keeps rounding from making that two levels.
    step = float(np.log(100 / percent)) * 1.0001
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(step)).cast("int")
    members = members.withColumn("level", level)
    counts = members.groupBy("root", "level").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("g"))
    blocks = F.ceil(F.greatest(F.col("c") / F.lit(block), F.col("g") / F.lit(BLOCK_GRAMS))).cast("int")
    # one entry for each size level, of which there are a few hundred at most
    around = counts.groupBy("root").agg(F.sum("c").alias("size"), F.sum("g").alias("weight"), F.map_from_entries(F.collect_list(F.struct("level", blocks))).alias("of"))

    def at(shift: int) -> Column:
        return F.coalesce(F.try_element_at("of", F.col("level") + F.lit(shift)), F.lit(0))

    m = members.join(around, "root").select("*", at(0).alias("blocks"), at(1).alias("up"), at(-1).alias("down"))
    m = m.withColumn("i", F.pmod(F.xxhash64("digest", F.lit(7)), "blocks").cast("int"))

    def each(number: str, make) -> Column:
        return F.when(F.col(number) > 0, F.transform(F.sequence(F.lit(0), F.col(number) - 1), make)).otherwise(F.array().cast("array<string>"))

    def pair(l1, i1, l2, i2) -> Column:
        return F.concat_ws(":", l1.cast("string"), i1.cast("string"), l2.cast("string"), i2.cast("string"))

    lv, i = F.col("level"), F.col("i")
    parts = F.concat(
        each("blocks", lambda j: pair(lv, F.least(i, j), lv, F.greatest(i, j))),
        each("up", lambda j: pair(lv, i, lv + 1, j)),
        each("down", lambda j: pair(lv - 1, j, lv, i)))
    tasks = F.when((F.col("size") <= block) & (F.col("weight") <= BLOCK_GRAMS), F.array(F.lit("all"))).otherwise(parts)
    return m.select("doc_id", "mark", "digest", F.explode(tasks).alias("part"), "root").select(
        "doc_id", "mark", "digest", F.xxhash64("root", "part").alias("task"))


def task_texts(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows ``(task, text, digest)``: the text of each representative, found by its id and its mark, for one id may have very many texts."""
    tasks = tasks.select(F.col("doc_id").alias("rep"), F.col("mark").alias("rep_mark"), "digest", "task")
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    return texts.join(tasks, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark"))).select("task", "text", "digest")


def exact_links(docs: DataFrame, tasks: DataFrame, k: int, percent: int, table: np.ndarray = A.SPACED) -> DataFrame:
    """Rows ``(a, b)`` of digests: the spanning forest of the links inside each task."""
    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in distinct_runs(batches, "task", "digest", "text"):  # a representative may have very many equal rows
            texts = pa.table({"text": pa.array(cols["text"], pa.large_string())}).combine_chunks()
            known: dict[bytes, np.ndarray] = {}
            done = 0
            for batch in texts.to_batches():
                for part in A.slices(batch):
                    for s in _sets(part, "text", k, table):
                        d = _digest(s)
                        if d == cols["digest"][done]:  # another text may have the same doc_id and mark
                            known[d] = s
                        done += 1
            names = sorted(known)
            label = links_within([known[d] for d in names], percent)
            moved = np.flatnonzero(label != np.arange(len(names)))
            if moved.size:
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[i] for i in moved], pa.binary()), pa.array([names[label[i]] for i in moved], pa.binary())], ["a", "b"])

    return task_texts(docs, tasks).repartition("task").sortWithinPartitions("task", "digest", "text").mapInArrow(check, "a binary, b binary")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, table: np.ndarray = A.SPACED, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of ``k``-word shingles; ``component_id``
    is the smallest ``doc_id`` of the documents reachable over links. Needs columns ``doc_id`` and
    ``text``; others are ignored, whatever their names.

    * A null or wordless text has an empty set (``n_shingles`` 0) and is linked with nothing: its own id.
    * Fewer than ``k`` words: the whole sequence is the only shingle. Any length of text is taken whole.
    * Copies and repeated rows each give a row, all with one component. Rows with a null ``doc_id`` take part, and give
      a null ``component_id`` if no member has an id.
    * An empty table gives no rows.
    """
    return _components(docs, k, percent, table, block).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, table: np.ndarray = A.SPACED, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component of ``jaccard_components``: the one with the smallest ``doc_id``.

    Of several rows with that id the one with the smallest hash of its text stays, and one of rows that are equal in both. Documents
    without a shingle all stay; so do texts whose component has no id at all, one row for each text. All columns stay as they are.
    """
    found = cut_lineage(_components(docs, k, percent, table, block), "components")
    # written, so that a component with very many documents can be split in the join
    keeper = cut_lineage(found.where("n_shingles > 0 and component_id is not null").groupBy("component_id").agg(
        F.min(F.when(F.col("doc_id") == F.col("component_id"), F.col("mark"))).alias("kept_mark")), "keepers")
    stays = (F.col("n_shingles") == 0) | F.col("component_id").isNull() | F.coalesce(
        (F.col("doc_id") == F.col("component_id")) & (F.col("mark") == F.col("kept_mark")), F.lit(False))
    verdicts = found.join(keeper, "component_id", "left").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), stays.alias("stays"), (F.col("n_shingles") > 0).alias("some")).groupBy(
        "_id", "_mark").agg(F.max("stays").alias("_stays"), (F.max("some") & (F.count("*") > 1)).alias("_again"))
    verdicts = cut_lineage(verdicts, "verdicts")
    columns = docs.columns
    gone, again = _small(verdicts.where("not _stays")), _small(verdicts.where("_stays and _again").select("_id", "_mark"))
    row = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(docs["text"]).alias("_text"))
    here = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_mark"))
    kept = row.join(gone, here, "left_anti")
    single = kept.join(again, here, "left_anti").select("_row")
    return single.unionByName(kept.join(again, here, "left_semi").groupBy("_doc", "_text").agg(F.first("_row").alias("_row")).select("_row")).select("_row.*")


def _components(docs: DataFrame, k: int, percent: int, table: np.ndarray, block: int) -> DataFrame:
    """One row per document: ``doc_id``, ``mark``, ``n_shingles``, ``component_id``."""
    docs = docs.select("doc_id", "text")
    sets = cut_lineage(document_sets(docs, k, table), "sets")
    classes = sets.where("n_shingles > 0").groupBy("digest", "node", "n_shingles").agg(
        F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("mark"))  # of one row
    work = sets.agg(F.sum("n_shingles")).first()[0] or 0
    spark = docs.sparkSession
    buckets = int(min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), work / BUCKET)))
    near = components(candidate_links(docs, k, percent, buckets, table), "a", "b")
    members = cut_lineage(classes.join(near, "node"), "members")
    links = components(exact_links(docs, _small(cut_lineage(_tasks(members, percent, block), "tasks")), k, percent, table), "a", "b")
    lowest = members.select("digest", "doc_id").join(links.select(F.col("node").alias("digest"), F.col("root").alias("top")), "digest")
    ids = lowest.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    moved = lowest.join(ids, "top").select("digest", "component_id")
    # written, so that both sides of the last join are plain exchanges and a digest with very many copies can be split
    named = cut_lineage(classes.select("digest", "doc_id").join(moved, "digest", "left").select(
        "digest", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    return sets.join(named, "digest", "left").select(
        "doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
