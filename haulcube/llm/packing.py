"""Mixture-controlled packing into fixed-length sequences (operator 7).

Each source is a queue of tokens (a document's ids and one end id).  Windows of about `window` tokens are
filled round by round: in round w every queue adds its quantum - its target share of the window - to its
deficit counter, serves the whole tokens it holds and carries the fraction to the next window.  The
carried deficits telescope, so what queue s has served before round w is floor(w * tokens_s / rounds); no
window has to wait for the one before it, whichever partition it is in, and every window holds the
target proportions to within one token a queue.  By default the target is the corpus mixture, which
empties all queues in the last window; `targets` gives other weights (a queue that runs dry is skipped).

The windows stand one after the other in a single stream, which is cut every `length` tokens, so only the
last sequence is short: it is padded to `length`, except when its size is a power of two.

Tokens are written once with their partition and their place among the partition's tokens of the same
source; the places of partitions are prefix sums over one row per (partition, source).  Every source has a
queue of its own, however many there are: a table has one row per queue and window it is served in, with the
position of its tokens in the stream, and is joined to the pieces.

Defined results: a null text is empty and gives the end id alone; a null source is a queue of its own;
repeated rows are packed each; ids must be integers; empty tables give empty results; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written

LENGTH, WINDOW = 2048, 65536
#: Distinct runs remembered by one Python worker, about 200 bytes each.
REMEMBERED = 600_000
#: Marks that may follow a word as one run; not the apostrophe (contractions) nor the brackets of special tokens.
MARKS = b"!#$%&()*+,-./:;=?@"
LETTERS = "".join(chr(c) for c in range(0x250) if chr(c).isalpha())
#: Pre-tokenizer of word vocabularies: letter runs, single digits and other runs stand alone, white space is dropped.
RUNS = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Encoder:
    """`tokenizers` ids of a text, as little-endian uint32 bytes.

    Where the tokenizer's own description says that white space is dropped and letter runs stand alone, white-space
    chunks are independent and so are a word of letters and the marks after it: each distinct chunk or lower-cased
    letter run is encoded once.  Other tokenizers encode whole texts.  Arrow splits a batch and numbers its distinct chunks and
    runs, Python sees each distinct run of a batch once, and the ids are gathered by number.
    """

    def __init__(self, path: str):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.separate = (str((first.get("pattern") or {}).get("Regex", "")).endswith(RUNS) and first.get("behavior") == "Removed"
                         and steps == ["NFC", "Replace", "Lowercase"])
        special = [t for t in spec.get("added_tokens", []) if not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.cut, self.cut_id = (special[-1]["content"], special[-1]["id"]) if special else (None, None)
        # ids that end a run (the suffix of the merge model): they part runs that were encoded together
        suffix, vocab = spec["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of short texts, many to a call with a special token in between."""
        out = []
        plain = self.cut is None or any(b"<" in t for t in texts)
        for a in range(0, len(texts), 512):
            part = [t.decode() for t in texts[a:a + 512]]
            if plain:
                out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                continue
            ids = np.array(self.tokenizer.encode(self.cut.join(part), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.cut_id), len(ids))
            held = ids.tobytes()
            out += [held[4 * a:4 * b] for a, b in zip(np.append(0, ends[:-1] + 1).tolist(), ends.tolist())]
        return out

    def _encode_runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of single runs, many to a text; the run ends show in the ids."""
        out = []
        parts = [runs[a:a + 512] for a in range(0, len(runs), 512)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                out += self._encode_all(part)
                continue
            held, ends = ids.tobytes(), (4 * ends).tolist()
            out += [held[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _learn(self, runs: list[str], others: list[str]):
        """Add the ids of new single runs and of new other chunks to `known`."""
        new = [r.encode() for r in runs]
        self.known.update(zip(runs, self._encode_runs(new)))
        self.known.update(zip(others, self._encode_all([c.encode() for c in others])))

    def _pieces(self, chunks):
        """(first, rest, simple) of distinct chunks: a word of (Latin) letters and the marks after it are two runs, others stand whole.

        Letters up to U+024F are composed, so NFC leaves them; ASCII words are lower-cased here, others by the tokenizer.
        """
        word = pc.ascii_rtrim(chunks, MARKS.decode())
        simple = pc.and_(pc.equal(pc.utf8_ltrim(word, LETTERS), ""), pc.not_equal(word, ""))
        word = pc.if_else(pc.string_is_ascii(word), pc.ascii_lower(word), word)
        return pc.if_else(simple, word, chunks), pc.if_else(simple, pc.utf8_ltrim(chunks, LETTERS), ""), simple

    def _lookup(self, keys, simple):
        """(ids of all keys one after the other, begin, size) of distinct keys; `simple` tells the single runs."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.known[""] = b""
        names = keys.to_pylist()
        held = [self.known.get(k) for k in names]
        missing = [i for i, x in enumerate(held) if x is None]
        if missing:
            self._learn([names[i] for i in missing if simple[i]], [names[i] for i in missing if not simple[i]])
            for i in missing:
                held[i] = self.known[names[i]]
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        return np.frombuffer(b"".join(held), "<u4"), np.cumsum(size) - size, size

    def encode_column(self, texts) -> list[bytes]:
        """Ids of an Arrow array of strings (null: empty)."""
        texts = texts.fill_null("")
        if not self.separate:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        first, rest, simple = self._pieces(words.dictionary)
        runs = pa.concat_arrays([first, rest]).dictionary_encode()
        single = np.ones(len(runs.dictionary), bool)
        at = runs.indices.to_numpy()
        n = len(first)
        # a chunk that is no simple one (marks alone among them) is encoded whole
        single[at[:n][~simple.to_numpy(zero_copy_only=False)]] = False
        ids, begin, size = self._lookup(runs.dictionary, single)
        ids, size = _take(ids, begin, size, np.stack([at[:n], at[n:]], 1).ravel())
        size = size.reshape(-1, 2).sum(1)
        ids, size = _take(ids, np.cumsum(size) - size, size, words.indices.to_numpy())
        ends = np.append(0, np.cumsum(size))[split.offsets.to_numpy() - split.offsets[0].as_py()] * 4
        held = ids.tobytes()
        return [held[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        return self.encode_column(pa.array([t.decode() for t in texts], pa.string()))


def _take(values: np.ndarray, begin: np.ndarray, size: np.ndarray, index: np.ndarray):
    """(values, sizes) of the lists `index` of a ragged array, one after the other."""
    n = size[index]
    at = np.arange(int(n.sum()))
    at += np.repeat(begin[index] - (np.cumsum(n) - n), n)
    return values[at], n


def _encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept between its tasks."""
    import sys
    import types
    held = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders"))
    if path not in held.__dict__:
        held.__dict__[path] = Encoder(path)
    return held.__dict__[path]


def _slices(batch, column: int, rows: int = 2048, size: int = 8 << 20):
    """Slices of at most `rows` rows whose texts have about `size` bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right"))
        b = min(max(b, a + 1), a + rows)
        yield batch.slice(a, b - a)
        a = b


def tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """(id, queue, part, place, n, ids): ids are uint32 bytes; place counts the partition's earlier tokens of the queue."""
    source = F.col(source_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source)).alias("queue"),
                      F.col(text_col).alias("t"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_path)
        served: dict[str, int] = {}
        for batch in batches:
            for rows in _slices(batch, 2):
                place, n, ids = [], [], []
                for queue, x in zip(rows.column(1).to_pylist(), encoder.encode_column(rows.column(2))):
                    x += end
                    at = served.get(queue, 0)
                    served[queue] = at + len(x) // 4
                    place.append(at)
                    n.append(len(x) // 4)
                    ids.append(x)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array([part] * len(n), pa.int32()), pa.array(place, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(ids, pa.binary())], names=["id", "queue", "part", "place", "n", "ids"])
    return src.mapInArrow(run, "id long, queue string, part int, place long, n long, ids binary")


class Schedule:
    """Closed form of the deficit round-robin over queues of the given sizes and shares.

    Queue q gets share[q] / rounds of a token a round on top of its deficit; `served(w)` is what each queue
    has handed out before round w.  It holds all queues in arrays; `pack` computes the same by joins.
    """

    def __init__(self, sizes: list[int], shares: list[int], rounds: int):
        self.sizes, self.rounds = np.array(sizes, np.int64), rounds
        self.whole, self.rest = np.divmod(np.array(shares, np.int64), rounds)
        self.cache: dict[int, tuple] = {}

    def served(self, w: int) -> np.ndarray:
        # rest < rounds, so rest * w stays within 64 bits for up to 3e9 rounds
        return np.minimum(self.sizes, self.whole * w + self.rest * w // self.rounds)

    def window(self, w: int):
        """(served before, position in the stream of each queue's first token) of window w."""
        if w not in self.cache:
            if len(self.cache) > 256:
                self.cache.clear()
            before, after = self.served(w), self.served(w + 1)
            here = after - before
            self.cache[w] = before, after, int(before.sum()) + np.cumsum(here) - here
        return self.cache[w]

    def round_of(self, q: int, t: int) -> int:
        """The round that serves token t of queue q."""
        share = int(self.whole[q]) * self.rounds + int(self.rest[q])
        return ((t + 1) * self.rounds - 1) // share

    def pieces(self, q: int, start: int, n: int):
        """(offset in the run, position in the stream, length) of tokens start..start+n-1 of queue q."""
        t = start
        while t < start + n:
            before, after, base = self.window(self.round_of(q, t))
            stop = min(start + n, int(after[q]))
            yield t - start, int(base[q]) + t - int(before[q]), stop - t
            t = stop


def _queues(sizes: DataFrame, window: int, targets: dict[str, float] | None) -> tuple[DataFrame, int, int]:
    """(written table of queue, size and share; tokens; rounds)."""
    total = int(sizes.agg(F.sum("size")).first()[0] or 0)
    rounds = max(1, -(-total // window))
    if targets is None:
        return sizes.withColumn("share", F.col("size")), total, rounds
    given = [("=" + k if k is not None else "null", float(v)) for k, v in targets.items()]
    given = sizes.sparkSession.createDataFrame(given, "queue string, weight double")
    weighed = written(sizes.join(given, "queue", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6))), "pack-weights")
    whole = float(weighed.agg(F.sum("weight")).first()[0] or 1.0)
    # tokens per round and queue as a fraction with the common denominator `rounds`
    share = F.greatest(F.lit(1), F.round(F.col("weight") / whole * window * rounds).cast("long"))
    return written(weighed.select("queue", "size", share.alias("share")), "pack-queues"), total, rounds


def _offsets(queues: DataFrame, rounds: int) -> DataFrame:
    """(queue, w, position): where the tokens of a queue in window w begin in the stream; only windows that hold some.

    A queue of a token or more a round is listed by window, another by token, each in a window of its own.
    """
    def round_of(t):
        return f"((cast({t} as decimal(20, 0)) + 1) * cast({rounds} as decimal(18, 0)) - 1) div share"

    def served(w):
        return f"least(size, (share div {rounds}) * {w} + (share % {rounds}) * {w} div {rounds})"
    last = F.expr(f"if(share >= {rounds}, {round_of('size - 1')}, size - 1)")
    chunks = queues.select("*", last.alias("last")).select("*", F.explode(F.expr("sequence(0L, last div 65536)")).alias("c")).repartition("queue", "c")
    here = chunks.select("queue", "size", "share", F.explode(F.expr("sequence(c * 65536, least(last, c * 65536 + 65535))")).alias("x"))
    here = here.select("queue", F.expr(f"if(share >= {rounds}, x, {round_of('x')})").alias("w"),
                       F.expr(f"if(share >= {rounds}, {served('(x + 1)')} - {served('x')}, 1L)").alias("n"))
    order = Window.partitionBy("w").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    here = written(here.select("queue", "w", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("inside")), "pack-windows")
    # tokens before each window: sums inside ranges of windows and over the ranges
    ranges = written(here.groupBy("w").agg(F.sum("n").alias("n")).repartitionByRange("w").withColumn("r", F.spark_partition_id()), "pack-ranges")
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.groupBy("r").agg(F.sum("n").alias("n")).select("r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))  # a row a partition
    inner = Window.partitionBy("r").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("r", "w", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("base")).join(F.broadcast(begins), "r")
    bases = written(ranges.select("w", (F.col("base") + F.col("begin")).alias("base")), "pack-bases")
    return written(here.join(small_side(bases), "w").select("queue", "w", (F.col("base") + F.col("inside")).alias("position")), "pack-offsets")


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, window: int = WINDOW, end_id: int = 1,
         targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: id, start, ids (uint32 bytes), length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens, padded_length."""
    table = written(tokens(docs, tokenizer_path, end_id, id_col, text_col, source_col), "pack-tokens")
    parts = written(table.groupBy("part", "queue").agg(F.sum("n").alias("n")), "pack-parts")
    sizes = written(parts.groupBy("queue").agg(F.sum("n").alias("size")), "pack-sizes")
    queues, total, rounds = _queues(sizes, window, targets)
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    base = written(base.join(queues, "queue"), "pack-base")
    placed = table.join(small_side(base), ["part", "queue"]).select("id", "queue", (F.col("base") + F.col("place")).alias("at"), "n", "ids", "size", "share")

    def windows(batches):
        """Cut each text where its queue's windows end."""
        for batch in batches:
            out, held_bytes = [], 0
            for i, q, at, n, ids, size, share in zip(*(c.to_pylist() for c in batch.columns)):
                t, end = at, at + n
                while t < end:
                    w = ((t + 1) * rounds - 1) // share
                    stop = min(end, size, share * (w + 1) // rounds)
                    held = ids[4 * (t - at):4 * (stop - at)]
                    out.append((i, q, w, t - share * w // rounds, t - at, n, held))
                    held_bytes += len(held)
                    t = stop
                    if len(out) >= 50_000 or held_bytes >= 16 << 20:
                        yield _pieces(out)
                        out, held_bytes = [], 0
            if out:
                yield _pieces(out)
    cut = placed.mapInArrow(windows, "id long, queue string, w long, skip long, start long, doc_tokens long, ids binary")
    cut = cut.join(small_side(_offsets(queues, rounds)), ["queue", "w"])
    cut = cut.select("id", "start", "doc_tokens", "ids", F.expr("octet_length(ids) div 4").alias("n"), (F.col("position") + F.col("skip")).alias("at"))
    # at most window / length + 1 sequences a piece
    rows = cut.select("*", F.explode(F.expr(f"sequence(at div {length}, (at + n - 1) div {length})")).alias("sequence_id"))
    rows = rows.select("*", F.expr(f"greatest(at, sequence_id * {length})").alias("first"), F.expr(f"least(at + n, (sequence_id + 1) * {length})").alias("stop"))
    last, rest = divmod(total, length)
    full = F.when(F.col("sequence_id") < last, length).otherwise(rest).cast("long")
    rows = rows.select("id", (F.col("start") + F.col("first") - F.col("at")).alias("start"),
                       F.expr("substring(ids, cast(4 * (first - at) + 1 as int), cast(4 * (stop - first) as int))").alias("ids"),
                       F.expr("stop - first").alias("length"), "doc_tokens", "sequence_id",
                       (F.col("first") - F.col("sequence_id") * length).alias("offset"), full.alias("sequence_tokens"))
    power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    rows = rows.withColumn("ids_crc32", F.crc32("ids")).withColumn("padded_length", F.when(power, F.col("sequence_tokens")).otherwise(length).cast("long"))
    return rows.select(*NAMES).withColumnRenamed("id", id_col)


def _pieces(rows):
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["id", "queue", "w", "skip", "start", "doc_tokens", "ids"])


NAMES = ["id", "start", "ids", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_length"]
