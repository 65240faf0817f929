"""Phrase collocations by direct-address tiling.

Texts become *chunks*: long runs of numbers that stand for words, with breaks between pieces.  The
frequent words are ranked by their count in the corpus, and the pairs of neighbours get addresses in
a square table of ranks that is cut into small tiles.  Addresses of a crowded tile are counted with a
dense bincount, all others as sorted coordinates, first in each task, then for each share of the tiles
from the blocks of all tasks; a block is a compressed sorted list, so little is shuffled.  The pairs
that are frequent are ranked anew and become the symbols of the next round, in which neighbours are
phrases one word longer.  A phrase can only be frequent if its two parts are, so nothing else is counted.

A table of frequent symbols goes to all tasks only if its counted rows are few; a larger one goes back
to the chunks by joins.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import materialize, text_or_empty

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: Words after which a chunk ends, and bytes of a long text taken at once (cut between pieces).
CHUNK_WORDS, CUT_BYTES = 2_000_000, 4_000_000
#: Bits of a tile's side; a tile with a quarter as many pairs as addresses is counted densely.
TILE_BITS = 6
#: Distinct pairs a task gathers before it sends them, and pairs (at most) of one share of the tiles.
SEND_PAIRS, SHARE_PAIRS = 4_000_000, 8_000_000
#: Frequent symbols up to which their table is broadcast (16 bytes each, words some more).
BROADCAST_SYMBOLS = 1_000_000
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 64

_BREAK = b"\xff"
#: ASCII letters in lower case, ends of pieces as a byte that UTF-8 never uses.
_BYTES = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, a ``_BREAK`` after every piece, in lists of about CUT_BYTES."""
    text, at = text.translate(_BYTES) + _BREAK, 0
    while at < len(text):
        end = text.find(_BREAK, min(at + CUT_BYTES, len(text) - 1)) + 1
        yield text[at:end].replace(_BREAK, b" \xff ").split()
        at = end


def without_repeated_breaks(seq: np.ndarray) -> np.ndarray:
    """``seq`` with each run of -1 as one -1, none at its ends."""
    keep = seq >= 0
    keep[1:] |= keep[:-1]
    out = seq[keep]
    return out[:-1] if len(out) and out[-1] < 0 else out


def addresses(a: np.ndarray, b: np.ndarray, symbols: int) -> np.ndarray:
    """The address of each pair of ranks: its tile, then its place in the tile."""
    side, low = (symbols >> TILE_BITS) + 1, (1 << TILE_BITS) - 1
    tile = (a.astype(np.int64) >> TILE_BITS) * side + (b >> TILE_BITS)
    return (tile << 2 * TILE_BITS) | ((a & low) << TILE_BITS) | (b & low)


def ranks(address: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that have these addresses."""
    side, low = (symbols >> TILE_BITS) + 1, (1 << TILE_BITS) - 1
    tile = address >> 2 * TILE_BITS
    return ((tile // side << TILE_BITS) | (address >> TILE_BITS & low), (tile % side << TILE_BITS) | (address & low))


def count_addresses(address: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct addresses, rising, and the sum of their weights (their number, without weights)."""
    size = 1 << 2 * TILE_BITS
    tiles, tile, many = np.unique(address >> 2 * TILE_BITS, return_inverse=True, return_counts=True)
    crowded = many * 4 >= size
    dense = crowded[tile]
    slot = (crowded.cumsum() - 1)[tile[dense]] * size + (address[dense] & size - 1)
    table = np.bincount(slot, None if weight is None else weight[dense], crowded.sum() * size)
    used = np.flatnonzero(table)
    from_dense = (tiles[crowded][used // size] << 2 * TILE_BITS) | (used % size)
    rest, back = np.unique(address[~dense], return_inverse=True)
    n = np.bincount(back, None if weight is None else weight[~dense], len(rest))
    key, n = np.concatenate([from_dense, rest]).astype(np.int64), np.concatenate([table[used], n]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], n[order]


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers as compressed planes of bytes."""
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _stored(seq: np.ndarray) -> tuple[int, bytes]:
    import pyarrow as pa

    return len(seq), pa.compress(seq.astype("<i4").tobytes(), "zstd", asbytes=True)


def _sequence(n: int, raw: bytes) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), "<i4")


def _neighbours(seq: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Where two symbols stand side by side, and the addresses of these pairs."""
    here = (seq[:-1] >= 0) & (seq[1:] >= 0)
    return here, addresses(seq[:-1][here], seq[1:][here], symbols)


def _chunks(docs: DataFrame, chunk_words: int) -> DataFrame:
    """(chunk, words, counts, n, seq): each chunk's words with their counts, its sequence and its length.

    ``words`` are compressed lines of language and word; ``seq`` holds their numbers, -1 between pieces.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        chunk, words, parts, size = TaskContext.get().partitionId() << 32, {}, defaultdict(list), 0

        def flush():
            seq, lines, counts = [], [], []
            for lang, known in words.items():
                own = np.concatenate(parts[lang])
                seq += [np.where(own > 0, own + (len(lines) - 1), -1).astype(np.int32), np.array([-1], np.int32)]
                counts.append(np.bincount(own, minlength=len(known))[1:])
                lines += [lang + b" " + w for w in itertools.islice(known, 1, None)]
            lines = b"\n".join(lines)  # neither languages as written here nor words hold a line end
            n, raw = _stored(without_repeated_breaks(np.concatenate(seq)))
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([len(lines)]), pa.array([pa.compress(lines, "zstd", asbytes=True)], pa.binary()),
                 pa.array([packed(np.concatenate(counts))], pa.binary()), pa.array([n]), pa.array([raw], pa.binary())],
                ["chunk", "bytes", "words", "counts", "n", "seq"])

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            for i, lang in enumerate(langs):
                for own in pieces_of(texts[i].as_py()):
                    known = words.get(lang)
                    if known is None:
                        known = words[lang] = defaultdict()
                        known.default_factory = known.__len__  # a new word gets the next number
                        known[_BREAK]
                    parts[lang].append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
                    size += len(own)
                    if size >= chunk_words:
                        yield flush()
                        chunk, size = chunk + 1, 0
                        words.clear()
                        parts.clear()
        if words:
            yield flush()

    # a language is kept in hexadecimal, so that it has no space or line end
    src = docs.select(F.hex("lang").cast("binary").alias("lang"), text_or_empty("text").cast("binary").alias("text"))
    return src.mapInArrow(run, "chunk long, bytes long, words binary, counts binary, n long, seq binary")


def _lines(raw: bytes, size: int) -> list[bytes]:
    import pyarrow as pa

    return pa.decompress(raw, size, "zstd", asbytes=True).split(b"\n") if size else []


def _words(chunks: DataFrame) -> DataFrame:
    """(chunk, code, line, n): a row per word of a chunk."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for chunk, size, raw, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bytes", "words", "counts")), strict=True):
                lines = _lines(raw, size)
                n = unpacked(counts, len(lines))
                for lo in range(0, len(lines), 20_000):
                    k = len(part := lines[lo:lo + 20_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, chunk)), pa.array(np.arange(lo, lo + k)), pa.array(part, pa.binary()), pa.array(n[lo:lo + k])],
                        ["chunk", "code", "line", "n"])

    return chunks.select("chunk", "bytes", "words", "counts").mapInArrow(run, "chunk long, code long, line binary, n long")


def _language(line: str = "line") -> Column:
    return F.unhex(F.substring_index(F.col(line).cast("string"), " ", 1)).cast("string")


def _named(chunks: DataFrame, words: DataFrame, level: DataFrame, many: int) -> DataFrame:
    """(chunk, n, seq): the chunks' sequences in frequent words, given by ``level`` (line, gid)."""
    if many > BROADCAST_SYMBOLS:
        return _renamed(chunks, words.select("chunk", "code", "line").join(level.select("line", "gid"), "line"), 0)
    table = level.select("line", "gid").toArrow().combine_chunks()
    fixed = chunks.sparkSession.sparkContext.broadcast((table.column("line").combine_chunks(), table.column("gid").to_numpy()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known, gid = fixed.value
        for batch in batches:
            for chunk, size, raw, n, seq in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bytes", "words", "n", "seq")), strict=True):
                at = pc.index_in(pa.array(_lines(raw, size), known.type), value_set=known)
                code = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                n, raw = _stored(_look_up(_sequence(n, seq), code, gid[at.drop_null().to_numpy()], 0))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([n]), pa.array([raw], pa.binary())], ["chunk", "n", "seq"])

    return chunks.mapInArrow(run, "chunk long, n long, seq binary")


def _ranked(found: DataFrame, name: str) -> DataFrame:
    """``found`` with ``gid``: 0, 1, ... in the order of falling f, written to the shared folder."""
    keys = [c for c in found.columns if c != "f"]
    order = [F.desc("f"), *keys]
    here = F.monotonically_increasing_id()
    own = (found.repartitionByRange(*order).sortWithinPartitions(*order)
           .withColumn("task", F.shiftright(here, 33)).withColumn("nth", here.bitwiseAND((1 << 33) - 1)))
    own = materialize(own, name)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = own.groupBy("task").agg(F.count("*").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return own.join(F.broadcast(starts), "task").withColumn("gid", F.col("start") + F.col("nth")).drop("task", "nth", "start")


def _renamed(chunks: DataFrame, names: DataFrame, symbols: int) -> DataFrame:
    """(chunk, n, seq): the chunks' sequences in the symbols that ``names`` (chunk, code, gid) gives them.

    A code is a number of the sequence, or with ``symbols`` the address of two neighbours.
    """

    def run(key, own, seq):
        import pyarrow as pa

        if not own.num_rows or not seq.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "seq": pa.array([], pa.binary())})
        code, gid = own.column("code").to_numpy(), own.column("gid").to_numpy()
        order = np.argsort(code)
        out = _look_up(_sequence(seq.column("n")[0].as_py(), seq.column("seq")[0].as_py()), code[order], gid[order], symbols)
        n, raw = _stored(out)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "seq": pa.array([raw], pa.binary())})

    own = names.select(F.col("chunk").alias("of"), F.col("code").cast("long").alias("code"), F.col("gid").cast("long").alias("gid"))
    return (own.groupBy("of").cogroup(chunks.select("chunk", "n", "seq").groupBy("chunk"))
            .applyInArrow(run, "chunk long, n long, seq binary"))


def _look_up(seq, code, gid, symbols):
    """``seq`` with each code replaced by its gid (codes rising), -1 for all others."""
    if symbols:
        here, own = _neighbours(seq, symbols)
    else:
        here, own = seq >= 0, seq[seq >= 0]
    at = np.minimum(np.searchsorted(code, own), len(code) - 1)
    out = np.full(len(here), -1, np.int64)
    out[here] = np.where(code[at] == own, gid[at], -1) if len(code) else -1
    return without_repeated_breaks(out)


def _paired(chunks: DataFrame, symbols: int, pairs: DataFrame, many: int) -> DataFrame:
    """(chunk, n, seq): the chunks' sequences of the frequent ``pairs`` (code, gid), of which there are ``many``."""
    if many > BROADCAST_SYMBOLS:
        def held(batches):
            import pyarrow as pa

            for batch in batches:
                for chunk, n, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "seq")), strict=True):
                    own = np.unique(_neighbours(_sequence(n, raw), symbols)[1])
                    for lo in range(0, len(own), 100_000):
                        part = own[lo:lo + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part)], ["chunk", "code"])

        return _renamed(chunks, chunks.mapInArrow(held, "chunk long, code long").join(pairs.select("code", "gid"), "code"), symbols)
    table = pairs.select("code", "gid").toArrow()
    code, gid = table.column("code").to_numpy(), table.column("gid").to_numpy()
    order = np.argsort(code)
    fixed = chunks.sparkSession.sparkContext.broadcast((code[order], gid[order]))

    def run(batches):
        import pyarrow as pa

        code, gid = fixed.value
        for batch in batches:
            for chunk, n, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "seq")), strict=True):
                n, raw = _stored(_look_up(_sequence(n, raw), code, gid, symbols))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([n]), pa.array([raw], pa.binary())], ["chunk", "n", "seq"])

    return chunks.mapInArrow(run, "chunk long, n long, seq binary")


def _pairs(chunks: DataFrame, symbols: int, min_count: int) -> DataFrame:
    """(code, left, right, f): neighbours found at least ``min_count`` times, by address and by ranks."""
    shares = max(1, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // SHARE_PAIRS))

    def send(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            key, n = held[0] if len(held) == 1 else count_addresses(*(np.concatenate(c) for c in zip(*held, strict=True)))
            share = (key >> 2 * TILE_BITS) * 0x9E3779B1 % 0x7FFFFFFF % shares
            order = np.argsort(share, kind="stable")  # the addresses of a share stay in order
            for own in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(share[own[0]])]), pa.array([len(own)]), pa.array([packed(np.diff(key[own], prepend=0))], pa.binary()),
                     pa.array([packed(n[own])], pa.binary())], ["share", "n", "code", "f"])

        for batch in batches:
            for n, raw in zip(batch.column("n").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                own = count_addresses(_neighbours(_sequence(n, raw), symbols)[1])
                if len(own[0]):
                    held.append(own)
                    size += len(own[0])
                if size >= SEND_PAIRS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def add(blocks):
        import pyarrow as pa

        key, f = [], []
        for n, code, count in zip(*(blocks.column(c).to_pylist() for c in ("n", "code", "f")), strict=True):
            key.append(unpacked(code, n).cumsum())
            f.append(unpacked(count, n))
        key, f = count_addresses(np.concatenate(key), np.concatenate(f))
        key, f = key[f >= min_count], f[f >= min_count]
        left, right = ranks(key, symbols)
        return pa.table({"code": pa.array(key), "left": pa.array(left), "right": pa.array(right), "f": pa.array(f)})

    return (chunks.select("n", "seq").mapInArrow(send, "share long, n long, code binary, f binary")
            .groupBy("share").applyInArrow(add, "code long, left long, right long, f long"))


def _longer(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The phrases of frequent ``pairs`` (gid, code, left, right, f), named and with the counts of their parts."""
    a = parts.select(F.col("gid").alias("left"), "lang", "phrase", "heads")
    b = parts.select(F.col("gid").alias("right"), F.col("last"), "tails")
    grown = pairs.join(a, "left").join(b, "right")
    return grown.select("gid", "lang", F.concat("phrase", F.lit(b" "), "last").alias("phrase"), "last", "f",
                        F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
                        "left", "right", "code")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT,
            chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases and the words of each language.

    Phrases: (lang, words, phrase, f, heads, tails, contained): ``heads`` and ``tails`` are the counts
    of the first and last 1, 2, ... words, ``contained`` is the largest count of a phrase one word
    longer that holds the phrase (0: none).  Words: (lang, n), all word occurrences.
    """
    src = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    chunks = materialize(_chunks(src, chunk_words), "phrase-words")
    words = _words(chunks)
    counts = materialize(words.groupBy("line").agg(F.sum("n").alias("f")), "word-counts")
    totals = counts.groupBy(_language().alias("lang")).agg(F.sum("f").alias("n"))
    named = F.expr("substring(line, locate(' ', cast(line as string)) + 1)")
    level = materialize(_ranked(counts.where(F.col("f") >= min_count), "frequent-words").select(
        "gid", "line", _language().alias("lang"), named.alias("phrase"), named.alias("last"), "f", F.array("f").alias("heads"),
        F.array("f").alias("tails")), "phrases-1")
    many = level.count()
    chunks = _named(chunks, words, level, many)
    levels = []
    for n in range(2, longest + 1):
        chunks, symbols = materialize(chunks, f"chunks-{n}"), many
        pairs = _ranked(_pairs(chunks, symbols, min_count), f"frequent-pairs-{n}")
        level = materialize(_longer(pairs, level), f"phrases-{n}")
        levels.append(level.withColumn("words", F.lit(n)))
        many = level.count()
        if not many:
            break
        if n < longest:
            chunks = _paired(chunks, symbols, level, many)
    out = []
    for n, own in enumerate(levels):
        if n + 1 < len(levels):
            up = levels[n + 1]
            holds = up.select(F.col("left").alias("gid"), F.col("f").alias("more")).unionByName(
                up.select(F.col("right").alias("gid"), F.col("f").alias("more")))
            own = own.join(holds.groupBy("gid").agg(F.max("more").alias("contained")), "gid", "left")
        else:
            own = own.withColumn("contained", F.lit(None).cast("long"))
        out.append(own.select("lang", "words", "phrase", "f", "heads", "tails", F.coalesce("contained", F.lit(0)).alias("contained")))
    every = out[0]
    for own in out[1:]:
        every = every.unionByName(own)
    return every, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
                 min_count: int = MIN_COUNT, percent: int = 100, top: int = TOP, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language.

    ASCII letters count in lower case; pieces end at ``. , ; : ! ?`` and line ends, words at spaces
    and tabs.  A phrase of 2 to ``longest`` words found ``a`` >= ``min_count`` times scores
    floor(1000 a n / (l r)) at its lowest-scoring cut (ties: the first), l and r the counts of both
    parts, n all words of the language.  A phrase held by a longer one with 100 f >= ``percent`` a
    is left out; one word longer is enough to look at, as what lies between is at least as frequent.
    Order: score and a falling, then the phrase's bytes.  Scores are exact (38 digits).

    Null texts are empty, a null language is ``und``; repeated rows count each time; empty tables or
    languages without phrases give no rows; other columns are not read.  Texts should be UTF-8: a
    byte 0xFF, which UTF-8 lacks, ends a piece.
    """
    if longest < 2:
        raise ValueError("longest must be at least 2")
    every, totals = phrases(docs, text_col, lang_col, longest, min_count, chunk_words)
    every = every.where(100 * F.col("contained") < percent * F.col("f")).join(totals, "lang")
    cut = F.expr("""array_min(transform(sequence(1, words - 1), k -> named_struct(
        'score', (1000BD * cast(f as decimal(17,0)) * cast(n as decimal(17,0)))
                 div (cast(heads[k - 1] as decimal(19,0)) * cast(tails[words - k - 1] as decimal(19,0))),
        'k', k, 'l', heads[k - 1], 'r', tails[words - k - 1])))""")
    scored = every.select("lang", "phrase", F.col("f").alias("a"), "n", cut.alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = Window.partitionBy("lang", "part").orderBy(*order)
    last = Window.partitionBy("lang").orderBy(*order)  # at most RANK_PARTS * top rows each
    return (scored.withColumn("part", part).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score"))


def query(spark, sf_dir):
    """The first 2000 collocations of every language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING k = 1 OR f >= 100),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
h AS MATERIALIZED (SELECT * FROM f WHERE f >= 100),  -- parts of a candidate are as frequent as itself
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM h WHERE k >= 2),
d AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.k > x.k AND y.f >= x.f
      AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
s AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, cut,
             CAST(1000::HUGEINT * c.f * n.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM c JOIN n ON n.lang = c.lang JOIN range(1, 5) AS t(cut) ON cut < c.k
      JOIN h l ON l.lang = c.lang AND l.k = cut AND l.phrase = array_to_string(c.w[1:cut], ' ')
      JOIN h r ON r.lang = c.lang AND r.k = c.k - cut AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
      WHERE (c.lang, c.phrase) NOT IN (SELECT (lang, phrase) FROM d)
      QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s QUALIFY rank <= 2000
"""
