"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes marks chunk ends, so chunks depend on content alone and fall into step
again after an insertion. A digest covers three chunks in a row (about 70 bytes), which makes chance repeats rare. A
digest that an earlier document has too is a repeated piece; where such pieces cover at least ``min_words`` words
in a row, those words are cut out. The document with the smallest ``doc_id`` keeps its text.

Copies of whole texts are found first, by a digest of the text with partial sums, and each
distinct text of a buffer is chunked once; so a text that a third of all rows share isn't sent
around once for each row. Digests travel packed by bucket, and what comes back to a document is
only the list of its own repeated digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltatree.llm import arrays as A
from deltatree.llm.jaccard import runs
from deltatree.session import cut_lineage

MIN_CHUNK, MAX_CHUNK, WINDOW, RUN = 8, 64, 16, 3
#: Digests a task gathers before it packs them, and digests of a bucket, about.
BUFFER, BUCKET = 500_000, 400_000
MIN_WORDS = 30
#: The last number of a document; rows with a null doc_id have the last ones, each its own.
LAST = (1 << 63) - 1

_GEAR = (A.mix(np.arange(256, dtype=np.uint64) + np.uint64(977)) >> np.uint64(32)).astype(np.uint32)


def chunk_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every chunk, and the len + 1 offsets of documents into them; chunks end between characters."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << np.uint32(2 * shift)
    # a chunk may begin after a byte whose hash starts with four zero bits
    found = np.flatnonzero((h[:-1] < np.uint32(1 << 28)) & A.code_points(data[1:])) + 1 if data.size else np.zeros(0, np.int64)
    bounds = np.searchsorted(found, at)
    candidates, starts, of = found.tolist(), [], [0]
    for d in range(len(at) - 1):
        begin, end = int(at[d]), int(at[d + 1])
        last, first = begin, begin + WINDOW  # before that, the hash would hold bytes of the document in front
        if end > begin:
            starts.append(begin)
        for p in (*candidates[bounds[d]:bounds[d + 1]], end):
            while p - last > MAX_CHUNK:
                last += MAX_CHUNK
                while data[last] & 0xC0 == 0x80:
                    last -= 1
                starts.append(last)
            if p >= first and p - last >= MIN_CHUNK and p < end:
                starts.append(p)
                last = p
        of.append(len(starts))
    return np.array(starts, np.int64), np.array(of, np.int64)


def digests(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, their offsets, chunk starts, their offsets, and for each chunk the digest of it and the next two.

    The last two chunks of a document have digests without meaning.
    """
    text, at = A.text_bytes(column)
    data = np.frombuffer(text, np.uint8)
    starts, of = chunk_starts(data, at)
    ends = np.append(starts[1:], data.size)
    return text, at, starts, of, A.rolling(A.span_hashes(data, starts, ends), RUN)


def text_digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


#: Blocks of characters that are written without blanks between words (first, last code point): Thai to Lao, Myanmar, Khmer, kana and CJK.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def unspaced(data: np.ndarray) -> np.ndarray:
    """True at each byte of a character of a block without blanks."""
    out = np.zeros(data.size, bool)
    first = np.flatnonzero(data >= 0xE0)
    if not first.size:
        return out
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    lead, one, two, three = (wide[first + i] for i in range(4))
    code = np.where(lead < 0xF0, (lead & 15) << 12 | (one & 63) << 6 | two & 63, (lead & 7) << 18 | (one & 63) << 12 | (two & 63) << 6 | three & 63)
    mine = np.zeros(first.size, bool)
    for low, high in UNSPACED:
        mine |= (code >= low) & (code <= high)
    for i in range(4):
        at = first[mine & (i < 3 + (lead >= 0xF0))] + i
        out[at[at < data.size]] = True
    return out


def repeated_words(data: bytes, spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Spans of whole words, each from a first byte of a word to the next one's, inside ``spans`` if they hold enough words.

    A character of a script without blanks stands for itself; two of them count as a word.
    """
    out = []
    for b, e in spans:
        low, high = max(0, b - 4), min(len(data), e + 4)  # with the characters next to it
        near = np.frombuffer(data[low:high], np.uint8)
        alone, inside = unspaced(near), A.SPACED[near]
        # a word begins after a blank, at a character that stands for itself, and after one
        begins = inside & A.code_points(near)
        begins[1:] &= ~inside[:-1] | alone[1:] | alone[:-1]
        if low:
            begins[0] = False
        starts = np.flatnonzero(begins[b - low:e - low])
        # the word that runs over the end isn't whole
        whole = e == len(data) or not inside[e - low] or begins[e - low] or not inside[e - 1 - low]
        last = len(starts) if whole else len(starts) - 1
        if last <= 0:
            continue
        weight = np.where(alone[b - low + starts[:last]], 1, 2).sum()
        if weight >= 2 * min_words:
            out.append((b + int(starts[0]), e if last == len(starts) else b + int(starts[last])))
    return out


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, bytes]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            first: dict[bytes, int] = {}
            for _, doc, name in held:
                first[name] = min(first.get(name, LAST), doc)
            rows = {name: d for d, _, name in held}
            digest = np.concatenate(list(rows.values()))
            doc = np.repeat(np.array([first[n] for n in rows], np.int64), [x.size for x in rows.values()])
            bucket = ((digest >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            digest, doc = digest[order], doc[order]
            used = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([
                pa.array(used, pa.int32()), pa.array([digest[cut[i]:cut[i + 1]].tobytes() for i in used], pa.binary()),
                pa.array([doc[cut[i]:cut[i + 1]].tobytes() for i in used], pa.binary())], ["bucket", "digest", "doc"])

        for batch in batches:
            for part in A.slices(batch):
                text, at, _, of, digest = digests(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                for d in range(part.num_rows):
                    mine = digest[of[d]:max(of[d], of[d + 1] - RUN + 1)]
                    if mine.size:
                        held.append((np.unique(mine), ids[d], text_digest(text[at[d]:at[d + 1]])))
                        total += mine.size
                if total >= BUFFER:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(emit, "bucket int, digest binary, doc binary")


def _repeats(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows ``(doc_id, digests, firsts)``, one for each document: its digests that an earlier one has, and that one's id."""
    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in runs(batches, "bucket", ("digest", "doc")):
            digest, doc = np.frombuffer(b"".join(cols["digest"]), np.uint64), np.frombuffer(b"".join(cols["doc"]), np.int64)
            order = np.lexsort((doc, digest))
            digest, doc = digest[order], doc[order]
            begin = np.concatenate([[True], digest[1:] != digest[:-1]])
            first = doc[np.maximum.accumulate(np.where(begin, np.arange(doc.size), 0))]
            later = np.flatnonzero(first != doc)
            if not later.size:
                continue
            target = (A.mix(doc[later].view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(target, kind="stable")
            later, target = later[order], target[order]
            cut = np.flatnonzero(np.concatenate([[True], np.diff(target) != 0, [True]]))
            yield pa.RecordBatch.from_arrays([pa.array(target[cut[:-1]], pa.int32()), *(
                pa.array([x[later[b:e]].tobytes() for b, e in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (doc, digest, first))],
                ["target", "doc", "digest", "first"])

    def sort_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in runs(batches, "target", ("doc", "digest", "first")):
            doc, digest, first = (np.frombuffer(b"".join(cols[c]), t) for c, t in (("doc", np.int64), ("digest", np.uint64), ("first", np.int64)))
            order = np.argsort(doc, kind="stable")
            doc, digest, first = doc[order], digest[order], first[order]
            cut = np.flatnonzero(np.concatenate([[True], np.diff(doc) != 0, [True]]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[cut[:-1]], pa.int64()), *(
                pa.array([x[b:e].tobytes() for b, e in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (digest, first))], ["doc_id", "digests", "firsts"])

    def together(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(key).sortWithinPartitions(key)

    found = together(packed, "bucket").mapInArrow(meet, "target int, doc binary, digest binary, first binary")
    return together(found, "target").mapInArrow(sort_out, "doc_id long, digests binary, firsts binary")


def _copies(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, digests, firsts)``: the digest of a whole text that an earlier document has, as 16 bytes."""
    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, at = A.text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([text_digest(text[b:e]) for b, e in zip(at, at[1:], strict=False)], pa.binary())], ["doc_id", "copy"])

    # both tables are written, so that a text with very many copies can be split in the join
    named = cut_lineage(docs.mapInArrow(name, "doc_id long, copy binary").distinct(), "texts")
    first = cut_lineage(named.groupBy("copy").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "copies")
    return named.join(first, "copy").where("doc_id > first").select("doc_id", "copy", "first")


def _numbered(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows ``(_row, _key, text)`` with the number of the document; the bytes of all text, and the first number that stands for no ``doc_id``.

    The number is the ``doc_id``. Rows without one are written with theirs, so that each keeps it whenever it is read.
    """
    row, key = F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs["doc_id"].cast("long")
    size, nulls, largest = docs.agg(F.sum(F.octet_length(docs["text"])), F.count_if(key.isNull()), F.max(key)).first()
    if not nulls:
        return docs.select(row, key.alias("_key"), docs["text"].alias("text")), size or 0, LAST + 1
    base = LAST - nulls + 1
    if largest is not None and largest >= base:
        raise ValueError(f"doc_id {largest} leaves no numbers for {nulls} rows without one")
    none = cut_lineage(docs.where(key.isNull()).select(row, F.monotonically_increasing_id().alias("_key")), "no_ids")
    part, offsets, so_far = F.shiftright("_key", 33).cast("int"), [], base
    counts = {r.part: r["count"] for r in none.groupBy(part.alias("part")).count().collect()}  # one for each task that wrote
    for i in range(max(counts) + 1):
        offsets.append(str(so_far))
        so_far += counts.get(i, 0)
    number = F.get(F.split(F.lit(",".join(offsets)), ","), part).cast("long") + F.col("_key").bitwiseAND(F.lit((1 << 33) - 1))
    return docs.where(key.isNotNull()).select(row, key.alias("_key"), docs["text"].alias("text")).unionByName(
        none.select("_row", number.alias("_key"), F.col("_row.text").alias("text"))), size or 0, base


def _marked(docs: DataFrame, min_words: int, finish, schema) -> DataFrame:
    """``finish(part, new texts or None, spans' sources)`` over every document together with its repeated digests."""
    spark = docs.sparkSession
    rows, size, base = _numbered(docs)
    narrow = rows.select(F.col("_key").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = int(min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size / 24 / BUCKET)))
    known = _repeats(_packed(narrow, buckets), buckets).select("doc_id", "digests", "firsts", F.lit(None).cast("binary").alias("copy"), F.lit(None).cast("long").alias("first"))
    copies = _copies(narrow).select("doc_id", F.lit(None).cast("binary").alias("digests"), F.lit(None).cast("binary").alias("firsts"), "copy", "first")
    # one list of its own digests for each document
    lists = known.unionByName(copies).groupBy("doc_id").agg(*(F.collect_list(c).alias(f"_{c}") for c in ("digests", "firsts")),
                                                            F.collect_list(F.struct("copy", "first")).alias("_copies")).select(
        F.col("doc_id").alias("_id"), F.struct("_digests", "_firsts", F.expr("filter(_copies, x -> x.copy is not null)").alias("_copies")).alias("_found"))
    joined = rows.join(lists, F.col("_key") == F.col("_id"), "left").select("_row", "_key", "text", "_found")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                found = part.column("_found").to_pylist()
                some = np.flatnonzero([x is not None for x in found])
                texts: dict[int, tuple[str, list[int | None]]] = {}
                if some.size:
                    picked = part.take(pa.array(some))
                    text, at, starts, of, digest = digests(picked.column("text"))
                    for k, row in enumerate(some):
                        mine = text[at[k]:at[k + 1]]
                        cut, sources = _cut(mine, starts[of[k]:of[k + 1]] - at[k], digest[of[k]:of[k + 1]], found[row], min_words)
                        if cut:
                            sources = [x for x in sources if x < base] + [None] * any(x >= base for x in sources)
                            texts[int(row)] = (b"".join(mine[b:e] for b, e in zip([0, *(x[1] for x in cut)], [*(x[0] for x in cut), len(mine)], strict=True)).decode("utf-8", "replace"), sources)
                yield finish(part, texts)

    return joined.mapInArrow(run, schema)


def _cut(text: bytes, starts: np.ndarray, digest: np.ndarray, found: dict, min_words: int) -> tuple[list[tuple[int, int]], list[int]]:
    """What goes from a text, as ascending spans of bytes, and the documents that have it first."""
    for c in found["_copies"]:
        if c["copy"] == text_digest(text):
            whole = repeated_words(text, [(0, len(text))], min_words)
            return ([(0, len(text))], [c["first"]]) if whole else ([], [])
    known = np.frombuffer(b"".join(found["_digests"]), np.uint64)
    if starts.size < RUN or not known.size:
        return [], []
    firsts = np.frombuffer(b"".join(found["_firsts"]), np.int64)
    order = np.argsort(known, kind="stable")
    known, firsts = known[order], firsts[order]
    at = np.minimum(np.searchsorted(known, digest), known.size - 1)
    again = known[at] == digest
    again[starts.size - RUN + 1:] = False
    covered = np.zeros(starts.size + 1, bool)
    for shift in range(RUN):
        covered[shift:starts.size][again[:starts.size - shift]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered])))
    ends = np.append(starts, len(text))
    spans, sources = [], set()
    for b, e in zip(edges[::2], edges[1::2], strict=True):
        kept = repeated_words(text, [(int(ends[b]), int(ends[e]))], min_words)
        if kept:
            spans += kept
            sources |= set(firsts[at[b:e][again[b:e]]].tolist())
    return spans, sorted(sources)


def substring_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: ``doc_id``, ``text`` without repeated passages, ``n_removed`` (characters), ``repeated``
    (whether anything went), ``first_doc_ids`` (documents that keep what went).

    A passage of ``min_words`` words or more goes where an earlier document (a smaller ``doc_id``) has it (words are parted by white space; two
    characters of a script without blanks, such as Chinese or Thai, count as a word); its first and
    last words may stay, up to the chunk in which it begins and ends. Repeats inside one document stay.

    * A null text stays null; texts are taken whole, whatever their length. A copy of a whole text of fewer words stays.
    * Rows of one ``doc_id`` are one document: they don't lose text to each other. Rows with a null ``doc_id`` are each a document of its own and come
      last of all, in no set order; ``first_doc_ids`` ends with a null if one of them keeps what went.
    * An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    def finish(part: pa.RecordBatch, texts: dict[int, tuple[str, list[int | None]]]) -> pa.RecordBatch:
        old = part.column("text").to_pylist()
        new = [texts[i][0] if i in texts else t for i, t in enumerate(old)]
        return pa.RecordBatch.from_arrays([
            part.column("_row").flatten()[0], pa.array(new, pa.string()), pa.array([len(a or "") - len(b or "") for a, b in zip(old, new, strict=True)], pa.int64()),
            pa.array([i in texts for i in range(len(old))]), pa.array([texts[i][1] if i in texts else [] for i in range(len(old))], pa.list_(pa.int64()))],
            ["doc_id", "text", "n_removed", "repeated", "first_doc_ids"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return _marked(docs, min_words, finish, "doc_id long, text string, n_removed long, repeated boolean, first_doc_ids array<long>")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` as in ``substring_report``, and ``n_chars``, if there is one, as the length of it; other columns stay."""
    columns = docs.columns

    def finish(part: pa.RecordBatch, texts: dict[int, tuple[str, list[int | None]]]) -> pa.RecordBatch:
        fields = dict(zip(columns, part.column("_row").flatten(), strict=True))
        new = [texts[i][0] if i in texts else t for i, t in enumerate(part.column("text").to_pylist())]
        fields["text"] = pa.array(new, fields["text"].type)
        if "n_chars" in fields and texts:
            fields["n_chars"] = pa.array([len(new[i]) if i in texts else n for i, n in enumerate(fields["n_chars"].to_pylist())], fields["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(fields.values()), list(fields))

    return _marked(docs, min_words, finish, docs.schema)
