"""The search index of a set of notes: notes, chunks, links, postings by term, and vectors, as tables in a folder.

The index is a list of segments. A build writes one with everything, an update writes one with
what has changed and says which notes of the segments before it are gone; both become visible
with one commit of a manifest, so readers see the old index or the new one, never a mixture, and
a writer that dies leaves the old one. A reader that is pinned to a commit keeps what it reads
until ``vacuum`` has forgotten the commit. Vectors are parts of the manifest, too, by the hash of
what they were made from, and outlast builds.

Chunks are dealt into blocks of about BLOCK chunks of like length. A row of postings is a term in
a block, with the largest score that the term can give there, so a search for the best chunks
reads the rows of few blocks.
"""

from __future__ import annotations

import datetime as dt
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark.functions.plain_terms import count_plain_terms, plain_terms
from mdspark.functions.text import index_terms
from mdspark.operators import graph
from mdspark.operators.ordering import numbered
from mdspark.shipping import ship_package
from mdspark.sources import vault
from mdspark.sources.commits import CommitLog, Conflict
from mdspark.storage import path_of, scratch

#: Partitions of the postings by hash of the term; a query reads those of its terms.
BUCKETS = 64
#: Chunks of a block, about, and classes of length for each doubling of it.
BLOCK, CLASSES = 64, 4
#: Bytes of text whose postings one task sorts, about; words whose postings are packed together, and of which a worker sorts the postings at once; rows of postings in a batch.
PART, WORDS, SORTED, ROWS = 16 << 20, 1 << 20, 4 << 20, 10_000
#: Fixed values of the ranking function.
K1, B = 1.2, 0.75
#: Segments, or parts of the vectors, that are merged into one when an update makes them more; commits whose tables are kept.
MANY, KEEP = 8, 3
#: Changed files that are read one by one; if there are more, all are read.
FILES = 10_000
#: Texts in a batch of the encoder.
BATCH = 64
#: Columns that readers of a table rely on.
COLUMNS = {
    "notes": {"path": "string", "title": "string", "frontmatter_json": "string", "mtime": "long", "size": "long"},
    "chunks": {"chunk_id": "long", "path": "string", "title": "string", "heading": "string", "body": "string", "content_hash": "string"},
    "links": {"source_path": "string", "ordinal": "int", "raw_target": "string", "heading": "string", "is_embed": "boolean", "target_path": "string"},
}
EMBEDDINGS = "content_hash string, model string, dimensions int, vector array<float>"
PASSAGE, QUERY = "passage: ", "query: "


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_number(term: str) -> int:
    """The same of one word, without a job."""
    unsigned = xxhash.xxh64_intdigest(term.encode(), 42)
    return (unsigned - (1 << 64) if unsigned >> 63 else unsigned) % BUCKETS


_POSTINGS = "term string, block long, n int, impact double, ids array<long>, freqs array<int>, dls array<int>, positions array<array<int>>"
#: Rows of postings on their way to the files of a slice: those of many terms and blocks in one row, their numbers end to end.
_PACKED = "slice int, terms string, blocks binary, ns binary, ids binary, freqs binary, dls binary, positions binary"
_KINDS = np.int64, np.int32, np.int64, np.int32, np.int32, np.int32


def parts_of(spark: SparkSession, size: int) -> int:
    """Into how many parts ``size`` bytes of text are dealt: the session's number, or as many as keep a part to some PART bytes, so that its sort fits in a task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))


def postings_of(chunks: DataFrame, average: float, text: str = "search_text", parts: int = BUCKETS) -> DataFrame:
    """(bucket, term, block, n, impact, ids, freqs, dls, positions) of chunks (chunk_id, _block, _plain, text): a row for each term of a block.

    ``impact`` is the most that the term gives to the score of one of its n chunks, before the
    factor for how rare it is. Rows of a block that do not come one after the other make several
    rows of postings; each holds at most BLOCK chunks at a time. Buckets, or slices of a bucket by
    block if there are more ``parts``, are each in one partition. Rows are shuffled packed, as one
    for a slice of many blocks, as a row by itself would be many times as large as what it holds.
    """
    ship_package(chunks.sparkSession)
    cut = -(-parts // BUCKETS)  # slices of a bucket
    slices = BUCKETS * cut if cut > 1 else parts
    flat = lambda arrays: np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    names = [part.split()[0] for part in _PACKED.split(", ")]

    def rows_of(block: int, ids: list[int], words: list[pa.Array]) -> tuple:
        """Of each term of the block: the term, the number of its chunks; of each of these: its id, frequency, length; the positions."""
        dls = np.array([len(w) for w in words], np.int32)
        coded = pa.concat_arrays([w.cast(pa.string()) for w in words]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(words)), dls)
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in dls])
        order = np.argsort(codes, kind="stable")  # by term, then chunk, then place
        codes, owner = codes[order], owner[order]
        entry = np.concatenate(([0], np.flatnonzero((codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])) + 1))
        freqs = np.diff(np.concatenate((entry, [len(codes)])))
        who, of_term = owner[entry], codes[entry]
        term = np.concatenate(([0], np.flatnonzero(of_term[1:] != of_term[:-1]) + 1))
        ns = np.diff(np.concatenate((term, [len(entry)])))
        return coded.dictionary.take(pa.array(of_term[term])), np.full(len(term), block, np.int64), ns, np.array(ids, np.int64)[who], freqs, dls[who], place[order]

    def packed(held: list[tuple]) -> pa.RecordBatch:
        terms = pa.concat_arrays([h[0] for h in held])
        blocks, ns, ids, freqs, dls, positions = (flat([h[k] for h in held]) for k in range(1, 7))
        coded = terms.dictionary_encode()
        buckets = np.array([bucket_number(t) for t in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
        of_row = buckets * cut + blocks % cut if cut > 1 else buckets % slices
        order = np.argsort(of_row, kind="stable")
        entries = _gathered(ns, order)
        rows = np.bincount(of_row, minlength=slices)
        sizes = [rows, rows, np.bincount(of_row, ns, slices), np.bincount(np.repeat(of_row, ns), freqs, slices)]
        at_row, _, at_entry, at_place = (np.concatenate(([0], np.cumsum(x))).astype(np.int32) for x in sizes)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at_row), terms.take(pa.array(order))), " ")
        places = [at_row, at_row, at_entry, at_entry, at_entry, at_place]
        values = [blocks[order], ns[order], ids[entries], freqs[entries], dls[entries], positions[_gathered(freqs, entries)]]
        parted = ([x[a:b].astype(kind).tobytes() for a, b in zip(at[:-1], at[1:])] for at, x, kind in zip(places, values, _KINDS))  # noqa: B905
        columns = [pa.array(np.arange(slices, dtype=np.int32)), joined, *(pa.array(x, pa.binary()) for x in parted)]
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(rows > 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, words, held, size = None, [], [], [], 0
        for batch in batches:
            plain = plain_terms(batch.column(2).drop_null().to_pylist())
            for chunk, block, is_plain, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).is_valid().to_pylist(), batch.column(3), strict=True):
                found = next(plain) if is_plain else other.values
                if ids and (block != at or len(ids) >= BLOCK):
                    held.append(rows_of(at, ids, words))
                    size += sum(map(len, words))
                    ids, words = [], []
                    if size >= WORDS:
                        yield packed(held)
                        held, size = [], 0
                at = block
                if found is not None and len(found):
                    ids.append(chunk)
                    words.append(found)
        if ids:
            held.append(rows_of(at, ids, words))
        if held:
            yield packed(held)

    def ordered(held: list[dict]) -> Iterator[pa.RecordBatch]:
        """Rows of postings in the order of their file, so that the sort finds them sorted."""
        coded = pa.concat_arrays([pc.split_pattern(pa.array([h["terms"]]), " ").flatten() for h in held]).dictionary_encode()
        blocks, ns, ids, freqs, dls, positions = (np.concatenate([np.frombuffer(h[name], kind) for h in held]) for name, kind in zip(names[2:], _KINDS))  # noqa: B905
        alphabetic = pc.sort_indices(coded.dictionary).to_numpy()
        buckets = np.array([bucket_number(t) for t in coded.dictionary.to_pylist()], np.int32)
        places = np.empty(len(buckets), np.int64)
        places[alphabetic[np.argsort(buckets[alphabetic], kind="stable")]] = np.arange(len(buckets))
        codes = coded.indices.to_numpy()
        order = np.lexsort((blocks, places[codes]))
        entries = _gathered(ns, order)
        codes, blocks, ns, ids, freqs, dls, positions = codes[order], blocks[order], ns[order], ids[entries], freqs[entries], dls[entries], positions[_gathered(freqs, entries)]
        at_row, at_entry = (np.concatenate(([0], np.cumsum(x))).astype(np.int32) for x in (ns, freqs))
        impact = np.maximum.reduceat(freqs * (K1 + 1) / (freqs + K1 * (1 - B + B * dls / average)), at_row[:-1])
        listed = lambda x: pa.ListArray.from_arrays(pa.array(at_row), x)
        columns = [
            pa.array(buckets[codes]), coded.dictionary.take(pa.array(codes)), pa.array(blocks), pa.array(ns), pa.array(impact),
            listed(pa.array(ids)), listed(pa.array(freqs)), listed(pa.array(dls)), listed(pa.ListArray.from_arrays(pa.array(at_entry), pa.array(positions))),
        ]
        whole = pa.RecordBatch.from_arrays(columns, ["bucket", *(c.split()[0] for c in _POSTINGS.split(", "))])
        yield from (whole.slice(a, ROWS) for a in range(0, whole.num_rows, ROWS))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["positions"]) // 4
                if size >= SORTED:
                    yield from ordered(held)
                    held, size = [], 0
        if held:
            yield from ordered(held)

    plain = F.when(F.col("_plain"), F.col(f"`{text}`")).alias("plain")
    terms = F.when(~F.col("_plain"), index_terms(F.col(f"`{text}`"))).alias("terms")
    rows = chunks.select("chunk_id", "_block", plain, terms).mapInArrow(pack, _PACKED)
    return rows.repartitionById(slices, F.col("slice")).mapInArrow(unpack, f"bucket int, {_POSTINGS}")


def _gathered(lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the items of lists that lie end to end go if the lists are put in an order."""
    start, taken = np.cumsum(lengths) - lengths, lengths[order]
    return np.repeat(start[order] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())


@dataclass
class Index:
    spark: SparkSession
    root: str
    #: The commit that is read; the latest one if None.
    version: int | None = None
    keep: int = KEEP

    # ---- commits ----
    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/log")

    def metadata(self) -> dict | None:
        """The manifest, or None if nothing was ever built."""
        made = self.log.read(self.version)
        return made if made and made["segments"] else None

    def pinned(self) -> Index:
        """The index as it is now, whatever is committed later."""
        if self.version is not None:
            return self
        known = self.log.versions()
        return replace(self, version=known[-1]) if known else self

    def _commit(self, change: Callable[[dict], dict], base: int | None = None) -> dict:
        """Commits what ``change`` makes of the latest manifest; if that must be commit ``base`` and isn't any more, raises Conflict."""
        for _ in range(20):
            last = self.log.read() or {"version": 0, "segments": [], "vectors": []}
            if base is not None and last["version"] != base:
                break
            try:
                made = self.log.commit(last["version"] + 1, change(last))
                self.vacuum()
                return made
            except Conflict:
                continue
        raise Conflict(f"another writer has changed {self.root}")

    def vacuum(self, keep: int | None = None, hours: float = 24) -> None:
        """Forgets all but the last commits, with the tables that only these name. Tables that no commit names go when they are ``hours`` old: a writer that died left them."""
        known = self.log.versions()
        kept, old = ([self.log.read(v) for v in some] for some in (known[-(keep or self.keep) :], known[: -(keep or self.keep)]))
        named, once = ({name for made in some for name in [*(x for s in made["segments"] for x in (s["folder"], *s.get("derived", {}).values())), *made["vectors"]]} for some in (kept, old))
        path, files = path_of(self.spark, self.root)
        for state in files.listStatus(path):
            name = state.getPath().getName()
            if re.fullmatch(r"(segment|vectors)-\w+", name) and name not in named:
                if name in once or time.time() - state.getModificationTime() / 1000 > 3600 * hours:
                    files.delete(state.getPath(), True)
        for made in old:
            self.log.drop(made["version"])

    # ---- building ----
    def build(self, chunks: DataFrame, notes: DataFrame | None = None, links: DataFrame | None = None, source: str = "", state: str = "", body: str = "search_text") -> Index:
        """Writes an index of ``chunks`` in place of what there is. ``notes`` and ``links`` are kept with it, ``source`` and ``state`` tell what it was built from."""
        segment = self._segment(chunks, notes, links, body)
        self._commit(lambda last: self._manifest([segment], last) | {"source": source, "state": state, "body": body})
        return self

    def update(self, chunks: DataFrame, notes: DataFrame | None = None, links: DataFrame | None = None, removed: DataFrame | None = None, relinked: DataFrame | None = None, state: str = "") -> Index:
        """Puts the notes whose paths are in ``chunks``, ``notes`` or ``removed`` (path) in place of those of the same paths; the rest is not read again.

        ``links`` are those of these notes, and of the notes in ``relinked`` (path), whose links
        alone are put in place. Another writer's commit in the meantime raises Conflict. More than
        MANY segments are merged.
        """
        now = self.pinned()
        made = now.metadata()
        if not made:
            raise ValueError(f"there is no index in {self.root}")
        body = made["body"]
        segment = self._segment(chunks, notes, links, body)
        folder = f"{self.root}/{segment['folder']}"
        paths = [f.select("path") for f in (chunks, notes, removed) if f is not None]
        gone = paths[0]
        for more in paths[1:]:
            gone = gone.unionByName(more)
        self._write(gone.distinct(), f"{folder}/gone")
        gone = self.spark.read.parquet(f"{folder}/gone")
        self._write(gone if relinked is None else gone.unionByName(relinked.select("path")).distinct(), f"{folder}/gone_links")
        old = now._live("chunks", everything=True).join(gone, "path", "left_semi")
        self._write(old.select("_segment", "_block", "chunk_id", "_dl", F.col(f"`{body}`").alias("text")), f"{folder}/dead")
        dead = self.spark.read.parquet(f"{folder}/dead")
        terms = dead.select(F.explode(F.array_distinct(index_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        self._write(terms.select(bucket_of(F.col("term")).alias("bucket"), "term", "n"), f"{folder}/minus", by="bucket")
        lost = dead.agg(F.count("*").alias("n"), F.count("_dl").alias("texts"), F.coalesce(F.sum("_dl"), F.lit(0)).alias("dl")).first()
        segment |= {"dead": lost["n"], "dead_texts": lost["texts"], "dead_length": lost["dl"], "delta": True}
        self._commit(lambda last: self._manifest([*made["segments"], segment], last) | {"state": state or made.get("state", "")}, base=made["version"])
        if len(made["segments"]) + 1 > MANY:
            self.compact()
        return self

    def compact(self) -> Index:
        """Merges the segments into one without what is gone; texts are not parted into terms again."""
        now = self.pinned()
        made = now.metadata()
        if not made or len(made["segments"]) < 2:
            return self
        name = self._name("segment")
        blocks, first = {}, 0
        for k, s in enumerate(made["segments"]):
            blocks[k], first = first, first + s["blocks"]
        base = F.element_at(F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair)), F.col("_segment")).cast("long")
        for table in ("chunks", "notes", "links"):
            if any(table in s["tables"] for s in made["segments"]):
                rows = now._live(table, everything=True)
                rows = rows.withColumn("_block", F.col("_block") + base) if table == "chunks" else rows
                self._write(rows.drop("_segment"), f"{self.root}/{name}/{table}")
        rows = now._blocks().withColumn("block", F.col("block") + base).select("bucket", *(c.split()[0] for c in _POSTINGS.split(", "))).where("n > 0")
        cut = -(-parts_of(self.spark, 6 * made["length"]) // BUCKETS)  # some 6 bytes a word
        rows = rows.repartition(BUCKETS * cut, "bucket", F.pmod("block", F.lit(cut)))
        self._write_postings(rows, f"{self.root}/{name}/postings")
        one = {
            "folder": name, "tables": sorted({t for s in made["segments"] for t in s["tables"]}), "blocks": first, "chunks": made["chunks"], "texts": made["texts"],
            "length": made["length"], "average": min(s["average"] for s in made["segments"]), "next_id": made["next_id"],
        }
        self._commit(lambda last: self._manifest([one], last) | {"state": made.get("state", "")}, base=made["version"])
        return self

    def _name(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex[:12]}"

    def _write(self, frame: DataFrame, where: str, by: str | None = None) -> None:
        writer = frame.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(where)

    def _write_postings(self, rows: DataFrame, where: str) -> None:
        """By bucket, in the order of terms and blocks, in small row groups, so that a search reads what it asks for."""
        rows.sortWithinPartitions("bucket", "term", "block").write.option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(where)

    def _segment(self, chunks: DataFrame, notes: DataFrame | None, links: DataFrame | None, body: str) -> dict:
        """Writes the tables of a segment, which no manifest names yet."""
        name = self._name("segment")
        folder = f"{self.root}/{name}"
        tables = {"notes": notes, "links": links}
        for table, frame in tables.items():
            if frame is not None:
                self._write(frame, f"{folder}/{table}")
        # classes of length by their number, with the first block and the number of blocks of each
        of_class = F.floor(CLASSES * F.log2(F.char_length(F.coalesce(F.col(f"`{body}`"), F.lit(""))) + 1)).cast("int")
        size = F.coalesce(F.sum(F.octet_length(F.col(f"`{body}`"))), F.lit(0))
        counts = chunks.groupBy(of_class.alias("c")).agg(F.count("*").alias("n"), F.max("chunk_id").alias("last"), size.alias("size")).orderBy("c").collect()  # some 31 * CLASSES rows at most
        first, spans = 0, []
        for r in counts:
            spans.append((r["c"], first, -(-r["n"] // BLOCK)))
            first += spans[-1][2]
        which = lambda k: F.element_at(F.create_map(*(F.lit(x) for s in spans for x in (s[0], s[k]))), of_class).cast("long")
        block = F.coalesce(which(1) + F.pmod(F.xxhash64("chunk_id"), which(2)), F.lit(0).cast("long")) if spans else F.lit(0).cast("long")
        ship_package(self.spark)
        whole = F.col(f"`{body}`")
        dealt = chunks.withColumn("_block", block).withColumn("_dl", count_plain_terms(whole)).withColumn("_plain", F.col("_dl") >= 0)
        dealt = dealt.withColumn("_dl", F.when(F.col("_plain"), F.col("_dl")).otherwise(F.when(whole.isNotNull(), F.size(index_terms(whole)))))
        parts = parts_of(self.spark, sum(r["size"] for r in counts))
        dealt = dealt.repartition(parts, "_block").sortWithinPartitions("_block", "chunk_id")
        self._write(dealt, f"{folder}/chunks")
        kept = self.spark.read.schema(dealt.schema).parquet(f"{folder}/chunks")
        size = kept.agg(F.count("*").alias("n"), F.count("_dl").alias("texts"), F.coalesce(F.sum("_dl"), F.lit(0)).alias("dl")).first()
        average = size["dl"] / size["texts"] if size["dl"] else 1.0
        self._write_postings(postings_of(kept, average, body, parts), f"{folder}/postings")
        return {
            "folder": name, "tables": ["chunks", "postings", *(t for t, f in tables.items() if f is not None)], "blocks": first, "chunks": size["n"], "texts": size["texts"], "length": size["dl"], "average": average,
            "next_id": max([r["last"] for r in counts if r["last"] is not None], default=-1) + 1,
        }

    def _manifest(self, segments: list[dict], last: dict) -> dict:
        """What readers need to know of the segments together."""
        chunks, texts, length = (sum(s[a] - s.get(b, 0) for s in segments) for a, b in (("chunks", "dead"), ("texts", "dead_texts"), ("length", "dead_length")))
        return last | {
            "segments": segments, "chunks": chunks, "texts": texts, "length": length, "average": length / texts if texts else 0.0, "next_id": max(s["next_id"] for s in segments),
            "indexed_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
        }

    def _kept(self, frame: DataFrame, name: str) -> DataFrame:
        """``frame`` written once, so that what is made of it does not read the files again."""
        folder = scratch(self.spark, name)
        self._write(frame, folder)
        return self.spark.read.schema(frame.schema).parquet(folder)

    def build_vault(self, folder: str) -> Index:
        """Reads the notes below ``folder`` and indexes them, links resolved. Chunks are numbered by path and place."""
        notes = self._kept(vault.read_vault(self.spark, folder), "notes")
        links = graph.resolve(vault.links(notes), notes)
        chunks = numbered(vault.chunks(notes).drop("chunk_id"), "chunk_id", F.asc("path"), F.asc("ordinal"))
        self.build(chunks, notes.drop("chunks", "links"), links, source=folder)
        return self

    def update_vault(self, folder: str) -> int:
        """Reads the notes that were added or modified since the last commit, and drops those removed; how many they are.

        Chunks that are new have numbers after all others. A note's links are resolved again if
        one of them may lead to a changed note, by its path or title.
        """
        now = self.pinned()
        made = now.metadata()
        before = now.table("notes").select("path", "title", "mtime", "size")
        changed = vault.staleness(vault.listing(self.spark, folder), before).limit(FILES + 1).collect()
        if not changed:
            return 0
        if len(changed) > FILES:
            self.build_vault(folder)
            return len(changed)
        notes = self._kept(vault.read_notes(self.spark, folder, [r["path"] for r in changed if r["change"] != "removed"]), "notes")
        gone = self.spark.createDataFrame([(r["path"],) for r in changed], "path string")
        chunks = numbered(vault.chunks(notes).drop("chunk_id"), "chunk_id", F.asc("path"), F.asc("ordinal"))
        chunks = chunks.withColumn("chunk_id", F.col("chunk_id") + F.lit(made["next_id"] - 1))
        after = before.join(F.broadcast(gone), "path", "left_anti").select("path", "title").unionByName(notes.select("path", "title"))  # at most FILES paths
        touched = graph.note_keys(before.join(F.broadcast(gone), "path", "left_semi").select("path", "title").unionByName(notes.select("path", "title")))
        kept = now.table("links").join(F.broadcast(gone.withColumnRenamed("path", "source_path")), "source_path", "left_anti")
        relinked = graph.link_keys(kept).join(touched, "key", "left_semi").select(F.col("source_path").alias("path")).distinct()
        links = vault.links(notes)
        links = links.unionByName(kept.join(relinked.withColumnRenamed("path", "source_path"), "source_path", "left_semi").select(links.columns))
        self.update(chunks, notes.drop("chunks", "links"), graph.resolve(links, after), gone, relinked)
        return len(changed)

    # ---- scans ----
    def table(self, name: str) -> DataFrame:
        """Notes, chunks, links, or postings (bucket, term, chunk_id, positions, dl)."""
        if name == "postings":
            return self._entries(self._blocks(), "positions", "dls").withColumnRenamed("dls", "dl")
        return self._live(name).drop("_segment")

    def derived(self, name: str, make: Callable[[DataFrame], DataFrame], table: str = "notes", by: str | None = None) -> DataFrame:
        """The live rows of a table that ``make`` makes of each segment's ``table``, note by note: it has their path, or source_path if made of links. ``by`` parts its files.

        It is made once for each segment, under ``name``, and kept with it, so an update makes it of
        what has changed alone.
        """
        made = self._made()
        folders = {}
        for _, s, folder in self._folders(made):
            if name not in s.get("derived", {}) and table in s["tables"]:
                folders[s["folder"]] = self._name("segment")
                self._write(make(self.spark.read.parquet(f"{folder}/{table}")), f"{self.root}/{folders[s['folder']]}", by)
        if folders:

            def kept(last: dict) -> dict:
                return last | {"segments": [s | {"derived": s.get("derived", {}) | {name: folders[s["folder"]]}} if s["folder"] in folders else s for s in last["segments"]]}

            self._commit(kept)
            made = kept(made)
        return self._live(name, made=made, of=table).drop("_segment")

    def edges(self) -> DataFrame:
        """(bucket, node, other, incoming, ordinal, source_path): each resolved link at either of its ends, parted by bucket of ``node`` and in its order.

        A note that very many link to has many rows, none of them large.
        """

        def make(links: DataFrame) -> DataFrame:
            known = links.where("target_path IS NOT NULL")
            end = lambda node, other, incoming: known.select(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(incoming).alias("incoming"), "ordinal", "source_path")
            rows = end("source_path", "target_path", False).unionByName(end("target_path", "source_path", True)).withColumn("bucket", bucket_of(F.col("node")))
            # a bucket with a hub is dealt to many tasks
            return rows.repartition("bucket", F.pmod(F.xxhash64("other"), F.lit(8))).sortWithinPartitions("bucket", "node", "other")

        return self.derived("edges", make, "links", "bucket")

    def edges_at(self, nodes: DataFrame) -> DataFrame:
        """The edges at the nodes (path): only the files of their buckets are read."""
        wanted = [r[0] for r in nodes.select(bucket_of(F.col("path"))).distinct().collect()]  # at most BUCKETS numbers
        return self.edges().where(F.col("bucket").isin(wanted)).join(nodes.select(F.col("path").alias("node")), "node")

    def _folders(self, made: dict) -> list[tuple[int, dict, str]]:
        return [(k, s, f"{self.root}/{s['folder']}") for k, s in enumerate(made["segments"])]

    def _made(self) -> dict:
        made = self.metadata()
        if not made:
            raise ValueError(f"there is no index in {self.root}")
        return made

    def _live(self, name: str, everything: bool = False, made: dict | None = None, of: str = "") -> DataFrame:
        """The rows of all segments, with the number of each, but for those that a later one says are gone."""
        key, gone = ("source_path", "gone_links") if "links" in (name, of) else ("path", "gone")
        made, rows, lost = made or self._made(), None, None
        for k, s, folder in self._folders(made):
            where = f"{folder}/{name}" if name in s["tables"] else f"{self.root}/{s['derived'][name]}" if name in s.get("derived", {}) else None
            if where:
                part = self.spark.read.option("mergeSchema", True).parquet(where).withColumn("_segment", F.lit(k))
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            if s.get("delta"):
                part = self.spark.read.parquet(f"{folder}/{gone}").select(F.col("path").alias(key), F.lit(k).alias("_gone"))
                lost = part if lost is None else lost.unionByName(part)
        if rows is None:
            raise ValueError(f"the index in {self.root} has no {name}")
        if lost is not None:
            rows = rows.join(lost.groupBy(key).agg(F.max("_gone").alias("_gone")), key, "left").where("_gone IS NULL OR _segment >= _gone").drop("_gone")
        # segments of an earlier version may lack a column
        for column, kind in COLUMNS.get(name, {}).items():
            if column not in rows.columns:
                rows = rows.withColumn(column, F.lit(None).cast(kind))
        return rows if everything else rows.drop("_block", "_dl", "_plain")

    def _read_postings(self, *columns: str) -> DataFrame:
        """Rows of postings of all segments as they were written."""
        rows = None
        for k, s, folder in self._folders(self._made()):
            part = self.spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{folder}/postings").select("bucket", F.lit(k).alias("_segment"), *columns)
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def _dead(self) -> DataFrame | None:
        """(_segment, _block, dead): the chunks of each block that later segments say are gone, at most a block's number."""
        parts = [self.spark.read.parquet(f"{folder}/dead").select("_segment", "_block", "chunk_id") for _, s, folder in self._folders(self._made()) if s.get("dead")]
        if not parts:
            return None
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy("_segment", F.col("_block").alias("block")).agg(F.collect_set("chunk_id").alias("_dead"))

    def _blocks(self, condition: Column | None = None, *columns: str) -> DataFrame:
        """Rows of postings without the chunks that are gone: all columns, or ids and some of freqs, dls, positions."""
        arrays = columns or ("freqs", "dls", "positions")
        rows = self._read_postings("term", "block", "n", "impact", "ids", *arrays)
        rows = rows if condition is None else rows.where(condition)
        dead = self._dead()
        if dead is None:
            return rows
        rows = rows.join(dead, ["_segment", "block"], "left")
        left = F.filter(F.arrays_zip("ids", *arrays), lambda e: F.col("_dead").isNull() | ~F.array_contains("_dead", e["ids"]))
        rows = rows.select("bucket", "_segment", "term", "block", "impact", left.alias("_left"))
        return rows.select("bucket", "_segment", "term", "block", F.size("_left").alias("n"), "impact", *(F.col(f"_left.{a}").alias(a) for a in ("ids", *arrays)))

    def _entries(self, rows: DataFrame, *arrays: str) -> DataFrame:
        """A row for each term of a chunk."""
        return rows.select("bucket", "term", F.explode(F.arrays_zip("ids", *arrays)).alias("_e")).select("bucket", "term", F.col("_e.ids").alias("chunk_id"), *(f"_e.{a}" for a in arrays))

    def chunks(self) -> DataFrame:
        """All chunks as hits of score 0, in the order of their ids."""
        return self.table("chunks").withColumn("score", F.lit(0.0)).orderBy("chunk_id")

    def pages(self) -> DataFrame:
        """All notes in the order of their paths; without readable properties they have none."""
        parsed = F.when(F.try_parse_json("frontmatter_json").isNotNull(), F.col("frontmatter_json")).otherwise("{}")
        return self.table("notes").withColumn("frontmatter_json", parsed).orderBy("path")

    def bodies(self, hits: DataFrame) -> DataFrame:
        """``hits`` with the bodies of their chunks, by id."""
        return hits.join(self.table("chunks").select("chunk_id", "body"), "chunk_id", "left")

    def _of_terms(self, terms: list[str]) -> Column:
        """A condition that is met by the partitions and rows of some terms."""
        return F.col("bucket").isin([bucket_number(t) for t in terms]) & F.col("term").isin(terms)

    def postings(self, terms: list[str]) -> DataFrame:
        """(bucket, term, chunk_id, positions, dl) of some terms; only their partitions are read."""
        return self._entries(self._blocks(self._of_terms(terms), "positions", "dls"), "positions", "dls").withColumnRenamed("dls", "dl")

    def entries(self, terms: list[str], blocks: Column | None = None) -> DataFrame:
        """(bucket, term, chunk_id, freqs, dls) of some terms, in the blocks that meet a condition on _segment and block."""
        condition = self._of_terms(terms)
        return self._entries(self._blocks(condition if blocks is None else condition & blocks, "freqs", "dls"), "freqs", "dls")

    def heads(self, terms: list[str]) -> DataFrame:
        """(_segment, block, term, n, impact) of some terms, without their lists; the impacts hold for the index as a whole."""
        made = self._made()
        wider = F.element_at(F.array(*(F.lit(max(1.0, made["average"] / s["average"])) for s in made["segments"])), F.col("_segment") + 1)
        rows = self._read_postings("term", "block", "n", "impact").where(self._of_terms(terms))
        return rows.groupBy("_segment", "block", "term").agg(F.sum("n").alias("n"), F.max(F.col("impact") * wider).alias("impact"))

    def frequencies(self, terms: list[str], heads: DataFrame | None = None) -> dict[str, int]:
        """How many chunks have each term: those of all segments but those that are gone."""
        rows = (self.heads(terms) if heads is None else heads).select("term", F.col("n").cast("long").alias("n"))
        for _, s, folder in self._folders(self._made()):
            if s.get("dead"):
                lost = self.spark.read.schema("term string, n long, bucket int").parquet(f"{folder}/minus").where(self._of_terms(terms))
                rows = rows.unionByName(lost.select("term", (-F.col("n")).alias("n")))
        return {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each word of a query

    # ---- vectors ----
    def embeddings(self) -> DataFrame:
        """The newest vector of each hash and model."""
        made = self.log.read(self.version)
        if not made or not made["vectors"]:
            return self.spark.createDataFrame([], EMBEDDINGS)
        parts = [self.spark.read.schema(EMBEDDINGS).parquet(f"{self.root}/{name}") for name in made["vectors"]]
        if len(parts) == 1:
            return parts[0]
        rows = parts[0].withColumn("_part", F.lit(0))
        for k, part in enumerate(parts[1:], 1):
            rows = rows.unionByName(part.withColumn("_part", F.lit(k)))
        newest = rows.groupBy("content_hash", "model").agg(F.max("_part").alias("_part"))
        return rows.join(newest, ["content_hash", "model", "_part"]).drop("_part")

    def store_embeddings(self, rows: DataFrame) -> None:
        """Rows (content_hash, model, dimensions, vector) replace those of the same hash and model; the others are not written again until there are many parts."""
        rows = rows.select("content_hash", "model", F.col("dimensions").cast("int"), F.col("vector").cast("array<float>")).dropDuplicates(["content_hash", "model"])
        name = self._name("vectors")
        self._write(rows, f"{self.root}/{name}")
        made = self._commit(lambda last: last | {"vectors": [*last["vectors"], name]})
        if len(made["vectors"]) > MANY:
            whole = self._name("vectors")
            self._write(replace(self, version=made["version"]).embeddings(), f"{self.root}/{whole}")
            merged = set(made["vectors"])
            self._commit(lambda last: last | {"vectors": [whole, *(v for v in last["vectors"] if v not in merged)]})

    def missing(self, model: str) -> DataFrame:
        """(content_hash, search_text) of the chunks without a vector of the model."""
        return vault.missing_embeddings(self.table("chunks"), self.embeddings(), model)

    def embed_missing(self, encoder: Encoder) -> int:
        """Encodes what is missing; the number of vectors made."""
        waiting = self.missing(encoder.model)
        made = encoder.encode(waiting.withColumn("search_text", F.concat(F.lit(PASSAGE), "search_text")), "search_text")
        n = waiting.count()
        if n:
            self.store_embeddings(made.select("content_hash", F.lit(encoder.model).alias("model"), F.size("vector").alias("dimensions"), "vector"))
        return n

    # ---- reports ----
    def statistics(self) -> DataFrame:
        """One row: how many notes, chunks and links there are."""
        count = lambda t: self.table(t).agg(F.count("*").alias(t))
        return count("notes").join(count("chunks")).join(count("links"))  # rows of one each

    def status(self, model: str = "", listing: DataFrame | None = None) -> DataFrame:
        """One row on the index: counts, unresolved links, vectors in use and in all, and whether files or vectors are out of date.

        ``listing`` (path, mtime, size) is what the notes are compared with.
        """
        made = self.metadata()
        if not made:
            return self.spark.createDataFrame([(False, None, None, 0, 0, 0, 0, 0, 0, True, True)], _STATUS)
        chunks, vectors = self.table("chunks"), self.embeddings()
        one = self.statistics().join(self.table("links").agg(F.count_if(F.col("target_path").isNull()).alias("unresolved_links")))
        used = chunks.join(vectors.select("content_hash").distinct(), "content_hash", "left_semi").agg(F.count("*").alias("embeddings"))
        one = one.join(used).join(vectors.agg(F.count("*").alias("cached_embeddings")))
        one = one.join(vault.staleness(listing, self.table("notes")).agg((F.count("*") > 0).alias("index_stale")) if listing is not None else self.spark.range(1).select(F.lit(False).alias("index_stale")))
        one = one.join(vault.missing_embeddings(chunks, vectors, model).agg((F.count("*") > 0).alias("embeddings_stale")))
        return one.select(F.lit(True).alias("has_index"), F.lit(made["source"]).alias("vault"), F.lit(made["indexed_at"]).alias("indexed_at"), "notes", "chunks", "links", "unresolved_links", "embeddings", "cached_embeddings", "index_stale", "embeddings_stale")


_STATUS = "has_index boolean, vault string, indexed_at string, notes long, chunks long, links long, unresolved_links long, embeddings long, cached_embeddings long, index_stale boolean, embeddings_stale boolean"


@dataclass
class Encoder:
    """Vectors of texts, a batch at a time. ``batch`` gets a list of texts and returns a list of vectors; the default hashes words, so that equal texts have equal vectors and shared words bring texts nearer."""

    model: str = "hashed-words-64"
    dimensions: int = 64
    batch: Callable[[list[str]], list[list[float]]] | None = None

    def encode(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with a column vector."""
        ship_package(rows.sparkSession)
        apply = self.batch or _Hashed(self.dimensions)

        @F.arrow_udf("array<float>")
        def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                out: list[list[float]] = []
                for k in range(0, len(part), BATCH):
                    out += apply([t or "" for t in part.slice(k, BATCH).to_pylist()])
                yield pa.array(out, pa.list_(pa.float32()))

        return rows.withColumn("vector", vectors(column))

    def query(self, text: str) -> list[float]:
        return (self.batch or _Hashed(self.dimensions))([QUERY + text])[0]


@dataclass
class _Hashed:
    dimensions: int

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import hashlib
        import re

        out = []
        for text in texts:
            sums = [0.0] * self.dimensions
            for word in re.findall(r"\w+", re.sub(r"^(passage|query): ", "", text).lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                sums[(h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
            size = sum(x * x for x in sums) ** 0.5 or 1.0
            out.append([x / size for x in sums])
        return out
