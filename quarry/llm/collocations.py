"""Phrase collocations of each language, counted by direct-address tiles.

Texts are read once, in chunks of some million words; a chunk's words get local
numbers, and their sequence goes to a file of the shared folder.  Words that
occur often enough are ranked by frequency over all documents, and each chunk
rewrites its sequence in ranks.  Neighbours are points of the pair plane, and
the plane is cut into tiles: ranks fall into blocks of about equal mass (the sum
of their words' counts), so the strip of a block's pairs holds a bounded number
of them; a word that is heavier than a block has a strip of its own, which the
blocks of the right words cut again.  So the tiles grow with the mass, and only
the heavy words' with the blocks.  A chunk hands on its pairs of each tile as
one packed row.  A tile's
rows meet in one task and are counted at direct addresses by ``bincount`` when
the tile is dense, else by sorted coordinates; each frequent pair goes on as one row, with
the numbers of the chunks that hold it.  Those are ranked in turn, and the same step on their sequence (each place
now holds the rank of the pair that begins there) counts phrases of three words,
then four, then five.

No table of words or pairs is broadcast, joined or held whole: a chunk's rows
carry the chunk's number through the counting and the ranking, which packs them
for it again.  A tile meets at
most twice ``BLOCK_MASS`` pairs, or one row a chunk where its words alone are heavier.
A phrase is counted only where both its parts are frequent, which loses none,
as no phrase is more frequent than its parts.

Defined cases: a null text is empty, a null lang is ``und``; rows without an id
count like others; empty texts and tables give no phrase; texts of any length
are read whole; repeated rows count each; equal scores are ordered by count,
then by the phrase's bytes; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, release, shared_path, small_batches
from .token_files import open_folder

#: Words of a chunk, about; a text's piece is never divided.
CHUNK_WORDS = 1 << 22
SLICE_BYTES = 1 << 20
#: Width of a tile, and from how many pairs on it is counted at direct addresses.
TILE = 512
DENSE = TILE * TILE // 8
#: Lower case, one separator of words and one of pieces.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\v\f\r", bytes(range(97, 123)) + b" \n\n\n\n\n\n\n\n\n")
BREAK, NOTHING = 0, 1
#: The mass of a block of ranks, and so the pairs that may meet in a tile.
BLOCK_MASS = 1 << 22
#: Ranked rows that a task holds before it packs them for the chunks.
PACKED_ROWS = 1 << 20
#: Cells of a tile that is counted at direct addresses in one array.
DENSE_CELLS = 1 << 22
#: Chunks that one row of a frequent pair names; further ones follow in rows of the same pair.
ROW_CHUNKS = 256
TILES = pa.schema([(c, pa.int64()) for c in ("chunk", "tile_left", "tile_right", "first_left", "first_right")] + [("pairs", pa.binary())])
FREQUENT = pa.schema([(c, pa.int64()) for c in ("left", "right", "f")] + [("chunks", pa.binary())])
WORDS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("symbol", pa.int64()), ("n", pa.int64())])


def pack(rows: np.ndarray) -> bytes:
    """Arrays of whole numbers of one length as bytes: differences, their lowest bytes first, compressed."""
    steps = np.diff(rows, axis=1, prepend=np.int64(0))
    steps = np.ascontiguousarray((steps << 1) ^ (steps >> 63), dtype="<i8").view("<u8")  # a small number for a small step to either side
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    planes = steps.view("u1").reshape(*steps.shape, 8)[:, :, :width].transpose(0, 2, 1).tobytes()
    return np.array([steps.shape[1], width], dtype="<i8").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(packed: bytes, columns: int) -> np.ndarray:
    n, width = np.frombuffer(packed, "<i8", count=2).tolist()
    planes = pa.decompress(memoryview(packed)[16:], columns * n * width, codec="zstd", asbytes=True)
    steps = np.zeros((columns, n, 8), dtype="u1")
    steps[:, :, :width] = np.frombuffer(planes, "u1").reshape(columns, width, n).transpose(0, 2, 1)
    steps = steps.view("<u8")[:, :, 0]
    return np.cumsum((steps >> 1).astype(np.int64) ^ -(steps & 1).astype(np.int64), axis=1)


def slices(text: str) -> Iterator[bytes]:
    """The folded text in parts of about SLICE_BYTES, cut between words."""
    raw = text.encode().translate(FOLD)
    a = 0
    while len(raw) - a > 2 * SLICE_BYTES:
        b = raw.find(b"\n", a + SLICE_BYTES, a + 2 * SLICE_BYTES) + 1
        if not b:
            b = raw.find(b" ", a + SLICE_BYTES) + 1
        if not b:
            break
        yield raw[a:b]
        a = b
    yield raw[a:]


class Chunk:
    """Local numbers of (lang, word) and the sequence of them; ``BREAK`` stands between pieces."""

    def __init__(self):
        number = itertools.count(2).__next__
        self.of: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number, {b"\n": BREAK, b"": NOTHING}))
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, part: bytes) -> None:
        tokens = part.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.of[lang].__getitem__, tokens), dtype=np.int64, count=len(tokens))
        self.parts.append(ids[ids != NOTHING].astype(np.int32))
        self.size += len(self.parts[-1])

    def end(self) -> None:
        self.parts.append(np.array([BREAK], dtype=np.int32))

    def close(self, folder: str) -> Iterator[pa.RecordBatch]:
        """Write the sequence; the words with their numbers and counts."""
        if not self.size:
            return
        sequence = np.concatenate(self.parts)
        chunk = write_sequence(folder, np.zeros(0, np.int64), sequence)
        counts = np.bincount(sequence)
        for lang, numbers in self.of.items():
            words = [(w, i) for w, i in numbers.items() if i > NOTHING]
            for a in range(0, len(words), 100_000):
                part = words[a:a + 100_000]
                symbols = np.array([i for _, i in part], dtype=np.int64)
                yield pa.record_batch([pa.array(np.full(len(part), chunk)), pa.array([lang] * len(part), pa.string()),
                                       pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array(symbols), pa.array(counts[symbols])], schema=WORDS)


def write_sequence(folder: str, values: np.ndarray, local: np.ndarray) -> int:
    """A compressed file of its attempt's own number: a sequence as places in ``values`` (-1: none).

    Only numbers that reach a written table are read again."""
    chunk = uuid.uuid4().int >> 65
    system, root = open_folder(folder)
    with system.open_output_stream(f"{root}/{chunk}.zst", compression="zstd") as f:
        f.write(np.array([len(values)], dtype="<i8").tobytes())
        f.write(values.astype("<i8").tobytes())
        f.write(local.astype("<i4").tobytes())
    return chunk


def read_sequence(folder: str, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    system, root = open_folder(folder)
    with system.open_input_stream(f"{root}/{chunk}.zst", compression="zstd") as f:
        raw = f.read()
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    return np.frombuffer(raw, dtype="<i8", count=n, offset=8), np.frombuffer(raw, dtype="<i4", offset=8 * (n + 1))


def count_pairs(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of numbers below ``size`` and how often each occurs; small numbers are the frequent ones."""
    across = -(-size // TILE)
    tile = (a // TILE).astype(np.int64) * across + b // TILE
    order = np.argsort(tile, kind="stable")
    a, b, tile = a[order], b[order], tile[order]
    starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(tile)))
    out, sparse = [], np.ones(len(tile), dtype=bool)
    for s, n in zip(starts[sizes >= DENSE].tolist(), sizes[sizes >= DENSE].tolist()):
        sparse[s:s + n] = False
        counts = np.bincount(a[s:s + n] % TILE * TILE + b[s:s + n] % TILE, minlength=TILE * TILE)
        at = np.flatnonzero(counts)
        out.append((a[s] // TILE * TILE + at // TILE, b[s] // TILE * TILE + at % TILE, counts[at]))
    # the sparse tiles' coordinates, sorted
    key, n = np.unique(a[sparse].astype(np.int64) * size + b[sparse], return_counts=True)
    out.append((key // size, key % size, n))
    return tuple(np.concatenate(x) for x in zip(*out))


def neighbours(folder: str, values: np.ndarray, blocks: np.ndarray, heavy: np.ndarray, local: np.ndarray) -> pa.Table:
    """Write a sequence of places in ``values`` (ranks in order), and pack the counted pairs of neighbours by tiles.

    A row's pairs are three arrays: offsets from ``first_left`` and
    ``first_right``, and counts.  ``heavy`` words have a block of their own,
    whose pairs are cut by the blocks of the right words; other blocks are one
    tile, with ``tile_right`` -1."""
    if len(local):
        local = local[np.append(True, (local[1:] >= 0) | (local[:-1] >= 0))]  # one gap is as good as many
    pairs = np.flatnonzero((local[:-1] >= 0) & (local[1:] >= 0))
    if not len(pairs):
        return TILES.empty_table()
    chunk = write_sequence(folder, values, local)
    a, b, n = count_pairs(local[pairs], local[pairs + 1], len(values))
    order = np.argsort(a.astype(np.int64) * len(values) + b)
    a, b, n = a[order], b[order], n[order]
    tile_left, tile_right = blocks[a], np.where(heavy[a], blocks[b], -1)
    starts = np.flatnonzero(np.append(True, (tile_left[1:] != tile_left[:-1]) | (tile_right[1:] != tile_right[:-1])))
    first_left, first_right = values[a[starts]], np.where(heavy[a[starts]], values[b[starts]], 0)
    sizes = np.diff(np.append(starts, len(a)))
    rows = np.stack([values[a] - np.repeat(first_left, sizes), values[b] - np.repeat(first_right, sizes), n])
    packed = [pack(rows[:, s:s + size]) for s, size in zip(starts.tolist(), sizes.tolist())]
    return pa.table([pa.array(np.full(len(starts), chunk)), pa.array(tile_left[starts]), pa.array(tile_right[starts]),
                     pa.array(first_left), pa.array(first_right), pa.array(packed, pa.binary())], schema=TILES)


def count_tile(least: int):
    """The frequent pairs of one tile, each with the chunks that hold it."""
    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunk, first_left, first_right = (table[c].to_numpy() for c in ("chunk", "first_left", "first_right"))
        low_left, low_right = int(first_left.min()), int(first_right.min())
        parts = [unpack(p.as_buffer(), 3) for p in table["pairs"]]
        for p, x, y in zip(parts, (first_left - low_left).tolist(), (first_right - low_right).tolist()):
            p[0] += x
            p[1] += y
        width, height = (max(int(p[i].max()) for p in parts) + 1 for i in (1, 0))
        row = np.repeat(np.arange(len(parts), dtype=np.int32), [p.shape[1] for p in parts])
        key, n = np.concatenate([p[0] * width + p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        del parts
        if width * height <= DENSE_CELLS:
            f = np.bincount(key, weights=n, minlength=width * height)[key]
        else:
            _, place = np.unique(key, return_inverse=True)
            f = np.bincount(place, weights=n)[place]
        keep = np.flatnonzero(f >= least)
        keep = keep[np.argsort(key[keep], kind="stable")]
        key, f, chunks = key[keep], f[keep].astype(np.int64), chunk[row[keep]].astype("<i8")
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        lengths = np.diff(np.append(heads, len(key)))
        # a pair's rows begin at its first chunk and after each ROW_CHUNKS of them
        starts = np.flatnonzero((np.arange(len(key)) - np.repeat(heads, lengths)) % ROW_CHUNKS == 0)
        ends = (np.append(starts, len(key)) * 8).astype(np.int32)
        named = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(chunks.tobytes())])
        return pa.table([pa.array(key[starts] // width + low_left), pa.array(key[starts] % width + low_right), pa.array(f[starts]), named], schema=FREQUENT)
    return apply


def unpacked(table: pa.Table, columns: int, block_mass: int) -> tuple[np.ndarray, ...]:
    """What a chunk gets of the ranking: its symbols (or lefts and rights), their ids, blocks and whether a block is theirs alone, in the order of ids."""
    out = []
    for packed, first, lighter in zip(table["packed"], table["first"].to_pylist(), table["lighter"].to_pylist()):
        rows = unpack(packed.as_buffer(), columns + 3)
        out.append(np.concatenate([rows[:-3], [rows[-3] + first, (rows[-2] + lighter) // block_mass, rows[-1] >= block_mass]]))
    rows = np.concatenate(out, axis=1)
    *rows, heavy = rows[:, np.argsort(rows[-3])]
    return *rows, heavy.astype(bool)


def rank_words(source: str, target: str, block_mass: int):
    def apply(table: pa.Table) -> pa.Table:
        _, sequence = read_sequence(source, table["chunk"][0].as_py())
        symbols, ids, blocks, heavy = unpacked(table, 1, block_mass)
        place = np.full(int(sequence.max()) + 1, -1, dtype=np.int32)
        place[symbols] = np.arange(len(ids), dtype=np.int32)
        return neighbours(target, ids, blocks, heavy, place[sequence])
    return apply


def rank_pairs(source: str, target: str, block_mass: int):
    def apply(table: pa.Table) -> pa.Table:
        values, local = read_sequence(source, table["chunk"][0].as_py())
        left, right, ids, blocks, heavy = unpacked(table, 2, block_mass)
        key = np.searchsorted(values, left) * len(values) + np.searchsorted(values, right)
        place = np.argsort(key).astype(np.int32)
        key = key[place]
        here = np.where((local[:-1] >= 0) & (local[1:] >= 0), local[:-1].astype(np.int64) * len(values) + local[1:], -1)
        at = np.minimum(np.searchsorted(key, here), len(key) - 1)
        return neighbours(target, ids, blocks, heavy, np.where(key[at] == here, place[at], np.int32(-1)))
    return apply


class Store:
    """A run's tables and files below one folder of the shared store."""

    def __init__(self, df: DataFrame):
        self.spark, self.root = df.sparkSession, shared_path(df.sparkSession, "collocations")

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def files(self, name: str) -> str:
        system, root = open_folder(f"{self.root}/{name}")
        system.create_dir(root, recursive=True)
        return f"{self.root}/{name}"

    def remove(self, *names: str) -> None:
        for name in names:
            system, root = open_folder(f"{self.root}/{name}")
            if system.get_file_info(root).type != fs.FileType.NotFound:
                system.delete_dir(root)


def numbered(store: Store, name: str, df: DataFrame, group: list[str], symbols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups by falling ``f``: a table of them with ``id``, their place from 0; and for each chunk its rows' symbols, packed with ids.

    A row is of one ``chunk``, or names its ``chunks`` in 8 bytes each.
    Rows are range-partitioned and sorted, so a group lies in one partition.  A
    pass along each partition numbers its groups, sums the mass before each, and
    packs what it has for each chunk; the partitions' totals, one small row
    each, say where each begins."""
    order = [F.desc("f"), *group]
    rows = df.repartitionByRange(partitions(store.spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    head = [f for f in rows.schema.fields if f.name in [*group, "f", "part"]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head) + ", place long, mass long, chunk long, packed binary"
    kinds = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32()}.get(f.dataType.simpleString(), pa.int64())) for f in head]
                      + [("place", pa.int64()), ("mass", pa.int64()), ("chunk", pa.int64()), ("packed", pa.binary())])

    def packs(held: list[np.ndarray], part: int) -> pa.RecordBatch:
        """One row a chunk: its symbols, places, the masses before them and ``f``, packed."""
        rows = np.concatenate(held, axis=1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        starts = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        columns = {"part": pa.array(np.full(len(starts), part, dtype=np.int32)), "chunk": pa.array(rows[0, starts]),
                   "packed": pa.array([pack(rows[1:, a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.shape[1]])], pa.binary())}
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(starts), f.type) for f in kinds], schema=kinds)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, groups, mass, held, size, part = None, 0, 0, [], 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            heads = np.zeros(n, dtype=bool)
            for c in group:
                x = batch.column(c)
                heads[1:] |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            heads[0] = [batch.column(c)[0] for c in group] != last
            last, part = [batch.column(c)[n - 1] for c in group], batch.column("part")[0].as_py()
            f = batch.column("f").to_numpy()
            places, sums = groups - 1 + np.cumsum(heads), mass + np.cumsum(f * heads)
            groups, mass = int(places[-1]) + 1, int(sums[-1])
            mine = np.stack([*[batch.column(c).to_numpy() for c in symbols], places, sums - f, f])
            if "chunks" in batch.schema.names:
                chunks = np.frombuffer(b"".join(batch.column("chunks").to_pylist()), "<i8")
                mine = np.repeat(mine, pc.binary_length(batch.column("chunks")).to_numpy() // 8, axis=1)
            else:
                chunks = batch.column("chunk").to_numpy()
            held.append(np.concatenate([[chunks], mine]))
            size += len(chunks)
            if size >= PACKED_ROWS:
                yield packs(held, part)
                held, size = [], 0
            at = pa.array(np.flatnonzero(heads))
            if len(at):
                made = {"place": pa.array(places[at]), "mass": pa.array(sums[at]), "chunk": pa.nulls(len(at), pa.int64()), "packed": pa.nulls(len(at), pa.binary())}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name).take(at).cast(f.type) for f in kinds], schema=kinds)
        if held:
            yield packs(held, part)

    placed = store.table(f"{name}-placed", rows.mapInArrow(number, schema))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = placed.where("chunk IS NULL").groupBy("part").agg((F.max("place") + 1).alias("n"), F.max("mass").alias("m"))
    totals = F.broadcast(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("lighter")))
    groups = placed.where("chunk IS NULL").join(totals, "part").select((F.col("first") + F.col("place")).alias("id"), *group, "f")
    return groups, placed.where("chunk IS NOT NULL").join(totals, "part").select("chunk", "packed", "first", "lighter")


def read_chunks(docs: DataFrame, folder: str, chunk_words: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for frame in frames:
            langs, texts = frame.column("lang"), frame.column("text")
            for i in range(frame.num_rows):
                for part in slices(texts[i].as_py()):
                    chunk.add(langs[i].as_py(), part)
                    if chunk.size >= chunk_words and part.endswith(b"\n"):
                        yield from chunk.close(folder)
                        chunk = Chunk()
                chunk.end()
                if chunk.size >= chunk_words:
                    yield from chunk.close(folder)
                    chunk = Chunk()
        yield from chunk.close(folder)
        release()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(read, "chunk long, lang string, word string, symbol long, n long")


def frequent_phrases(store: Store, docs: DataFrame, longest: int, least: int, chunk_words: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the phrases of 1, 2, ... words with ``least`` occurrences (id, f; lang and word, or left and right), and n of each lang."""
    words = store.table("words", read_chunks(docs, store.files("sequence-0"), chunk_words))
    totals = store.table("totals", words.groupBy("lang").agg(F.sum("n").alias("n")))
    # a word has one row a chunk here, so no word's window is longer than the number of chunks
    counted = words.withColumn("f", F.sum("n").over(Window.partitionBy("lang", "word"))).where(F.col("f") >= least)
    groups, known = numbered(store, "words", store.table("words-often", counted.drop("n")), ["lang", "word"], ["symbol"])
    levels = [store.table("phrases-1", groups)]
    store.remove("words", "words-often")
    step, spent = rank_words, "words-placed"
    for k in range(2, longest + 1):
        source, target = store.files(f"sequence-{k - 2}"), store.files(f"sequence-{k - 1}")
        tiles = store.table(f"tiles-{k}", known.groupBy("chunk").applyInArrow(step(source, target, BLOCK_MASS), "chunk long, tile_left long, tile_right long, first_left long, first_right long, pairs binary"))
        store.remove(f"sequence-{k - 2}", spent)
        often = store.table(f"often-{k}", tiles.groupBy("tile_left", "tile_right").applyInArrow(count_tile(least), "left long, right long, f long, chunks binary"))
        groups, known = numbered(store, f"pairs-{k}", often, ["left", "right"], ["left", "right"])
        levels.append(store.table(f"phrases-{k}", groups))
        store.remove(f"tiles-{k}", f"often-{k}")
        step, spent = rank_pairs, f"pairs-{k}-placed"
    store.remove(f"sequence-{longest - 1}", spent)
    return levels, totals


def lowest_cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cut of lowest score of each phrase, in whole numbers of any size."""
    for pdf in frames:
        found = []
        for a, n, firsts, rests in zip(pdf["a"].tolist(), pdf["n"].tolist(), pdf["firsts"], pdf["rests"]):
            cuts = zip(map(int, firsts), map(int, reversed(rests)))
            found.append(min((1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(cuts)))
        yield pd.DataFrame({"lang": pdf["lang"], "phrase": pdf["phrase"], "a": pdf["a"], "l": [f[2] for f in found], "r": [f[3] for f in found],
                            "n": pdf["n"], "score": [f[0] for f in found]})


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, first: int = 2000, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The ``first`` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    store = Store(docs)
    levels, totals = frequent_phrases(store, docs, longest, least, chunk_words)
    one = F.array("f")
    known = levels[0].select("id", "lang", F.array("word").alias("words"), one.alias("heads"), one.alias("tails"))
    out = None
    for k, level in enumerate(levels[1:], 2):
        # f of a phrase's beginnings and ends come from its two parts
        left = known.select(F.col("id").alias("left"), "lang", F.col("words").alias("w"), F.col("heads").alias("firsts"))
        right = known.select(F.col("id").alias("right"), F.element_at("words", -1).alias("end"), F.col("tails").alias("rests"))
        whole = level.join(left, "left").join(right, "right").select("id", "f", "lang", F.concat("w", F.array("end")).alias("words"), "firsts", "rests",
                                                                     F.concat("firsts", one).alias("heads"), F.concat("rests", one).alias("tails"))
        whole = store.table(f"whole-{k}", whole)
        kept = whole
        if k < longest:
            inside = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("g")).groupBy("id").agg(F.max("g").alias("g"))
            kept = whole.join(inside, "id", "left").where("g IS NULL OR g < f")
        kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "firsts", "rests")
        out = kept if out is None else out.unionByName(kept)
        known = whole
    scored = out.join(totals, "lang").mapInPandas(lowest_cut, "lang string, phrase string, a long, l long, r long, n long, score long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k) WHERE len(w) >= k) GROUP BY ALL),
f AS MATERIALIZED (SELECT lang, g, f, len(g) AS k FROM g WHERE f >= 100),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
c AS (SELECT f.lang, f.g, f.f AS a, l.f AS l, r.f AS r, n.n, 1000::HUGEINT * f.f * n.n // (l.f::HUGEINT * r.f) AS score,
 row_number() OVER (PARTITION BY f.lang, f.g ORDER BY 1000::HUGEINT * f.f * n.n // (l.f::HUGEINT * r.f), l.k) AS turn
 FROM f JOIN n USING (lang), range(1, 5) t(cut) JOIN f l ON TRUE JOIN f r ON TRUE
 WHERE f.k > cut AND l.lang = f.lang AND l.g = f.g[:cut] AND r.lang = f.lang AND r.g = f.g[cut + 1:]),
i AS (SELECT lang, unnest([g[:k - 1], g[2:]]) AS g, f FROM f WHERE k > 2),
x AS (SELECT lang, g, max(f) AS f FROM i GROUP BY ALL),
s AS (SELECT c.lang, array_to_string(c.g, ' ') AS phrase, a, l, r, n, score FROM c LEFT JOIN x ON x.lang = c.lang AND x.g = c.g WHERE turn = 1 AND (x.f IS NULL OR x.f < a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s) WHERE rank <= 2000"""
