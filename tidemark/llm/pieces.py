"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass of relaxation.

At each position the automaton's output links give every piece that ends there. Unigram models keep the best sum of
scores (Viterbi). In merge models a score is a merge's rank, not a weight, so sums would give other pieces than the model
means; there the one piece that can follow the best ending at its start without a merge across the seam is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import ship

SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class _Words(dict):
    """Packed ids of words, segmented when first asked for; long words aren't kept, and a full cache starts anew."""

    def __init__(self, coder: PieceCoder, before: str, most: int):
        self.coder, self.before, self.most = coder, before, most

    def __missing__(self, word: str) -> bytes:
        ids = _packed(self.coder._segment(self.before + word))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class PieceCoder:
    """Encodes and decodes with one model file's pieces."""

    def __init__(self, model: bytes, cache_words: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and merge models without normalisation are supported")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.score = [p.score for p in proto.pieces]
        self.lowest = min((self.score[i] for i in normal.values()), default=0.0) - 10.0
        order = sorted(normal.values(), key=lambda i: -self.score[i])
        self.rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.splits: dict[str, tuple[str, str]] = {}
        if self.kind == BPE:  # pieces that no merges make can't occur
            normal = {w: i for w, i in normal.items() if self._derive(w)}
        self.automaton = ahocorasick.Automaton()
        for word, i in normal.items():
            self.automaton.add_word(word, (len(word), i))
        self.automaton.make_automaton()
        self.inner = any(SPACE in p.lstrip(SPACE) for p in normal)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.seams: dict[int, bool] = {}
        self.cache = _Words(self, "", cache_words)
        self.plain = _Words(self, SPACE, cache_words)
        self.cache_words = cache_words
        control = {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        back = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([back[i]]) if i in back else b"" if i in control else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.raw_size = np.array([len(r) for r in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def _derive(self, word: str) -> bool:
        """Merge a piece's own characters; true if they end in the piece, whose last merge is then its split."""
        parts = list(word)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            joined = parts[best] + parts[best + 1]
            if joined not in self.rank:
                return False
            if len(parts) == 2:
                self.splits[word] = (parts[0], parts[1])
            parts[best : best + 2] = [joined]
        return True

    def _holds(self, left_id: int, right_id: int) -> bool:
        """Whether no merge crosses the seam between two pieces.

        Unwinds both pieces' merges along the seam, the later first. A merge of the two parts at the seam happens if its
        rank comes before both parts' next merges; of equal ranks, the one further left comes first.
        """
        left, right = self.pieces[left_id], self.pieces[right_id]
        never = 1 << 60
        until_left = until_right = never
        x, y, ok = left, right, True
        while True:
            r = self.rank.get(x + y, never)
            if r < until_left and r <= until_right and r != never:
                ok = False
                break
            rx = self.rank[x] if len(x) > 1 else -1
            ry = self.rank[y] if len(y) > 1 else -1
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                until_left, x = rx, self.splits[x][1]
            else:
                until_right, y = ry, self.splits[y][0]
        if len(self.seams) >= 4 * self.cache_words:
            self.seams.clear()
        self.seams[left_id << 24 | right_id] = ok
        return ok

    def _spell(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def _segment(self, word: str) -> list[int]:
        return self._best_sum(word) if self.kind == UNIGRAM else self._merged(word)

    def _merged(self, word: str) -> list[int]:
        """One pass over the automaton's outputs, the longest of an end first: kept is the one that its seam allows."""
        n = len(word)
        ids, starts = [-2] * (n + 1), [0] * (n + 1)  # of the last piece up to each end; -2 not reached, -1 an unknown character
        ids[0] = -1
        seams, holds = self.seams, self._holds
        for stop, (size, i) in self.automaton.iter(word):
            end = stop + 1
            if ids[end] != -2:
                continue
            start = end - size
            left = ids[start]
            if left == -2:  # all that ends there has been seen
                left = self._unknown(start, ids, starts)
            if left >= 0:
                ok = seams.get(left << 24 | i)
                if ok is None:
                    ok = holds(left, i)
                if not ok:
                    continue
            ids[end] = i
            starts[end] = start
        if ids[n] == -2:
            self._unknown(n, ids, starts)
        return self._traced(word, ids, starts)

    @staticmethod
    def _unknown(end: int, ids: list[int], starts: list[int]) -> int:
        """Positions up to ``end`` that no piece reaches take their character as unknown."""
        at = end
        while ids[at] == -2:
            ids[at], starts[at] = -1, at - 1
            at -= 1
        return -1

    def _best_sum(self, word: str) -> list[int]:
        """One pass over the automaton's outputs: each relaxes the best sum of scores at its end."""
        n = len(word)
        ids, starts, total = [-2] * (n + 1), [0] * (n + 1), [0.0] + [float("-inf")] * n
        ids[0], at = -1, 1

        def settle(end: int) -> None:
            """Ends before ``end`` are complete; an unknown character there may still be the best."""
            nonlocal at
            while at < end:
                if total[at - 1] + self.lowest > total[at]:
                    total[at], ids[at], starts[at] = total[at - 1] + self.lowest, -1, at - 1
                at += 1

        for stop, (size, i) in self.automaton.iter(word):
            end = stop + 1
            settle(end)
            start = end - size
            if total[start] + self.score[i] > total[end]:
                total[end], ids[end], starts[end] = total[start] + self.score[i], i, start
        settle(n + 1)
        return self._traced(word, ids, starts)

    def _traced(self, word: str, ids: list[int], starts: list[int]) -> list[int]:
        out, end = [], len(word)
        while end:
            i = ids[end]
            if i >= 0:
                out.append(i)
            else:
                out += reversed(self._spell(word[end - 1]))
            end = starts[end]
        out.reverse()
        return out

    def encode_raw(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers; none for a null or empty one."""
        if not text:
            return b""
        if self.inner:
            return _packed(self._segment((SPACE if self.prefix else "") + text.replace(" ", SPACE)))
        if self.prefix and text[0] != " " and "  " not in text and SPACE not in text:
            return b"".join(map(self.plain.__getitem__, text.split(" ")))
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return b"".join(map(self.cache.__getitem__, self.words.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_raw(text), np.int32).tolist()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of many texts, whose ids lie in one array up to ``ends``; the prefix's space is taken off."""
        sizes = self.raw_size[ids]
        after = np.cumsum(sizes)
        picked = np.repeat(self.raw_start[ids] - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)
        flat = self.raw_bytes[picked].tobytes()
        stops = np.where(ends > 0, np.append(after, 0)[ends - 1], 0).tolist()
        out, a = [], 0
        for b in stops:
            out.append(flat[a + (self.prefix and flat[a : a + 1] == b" " and b > a) : b])
            a = b
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; byte pieces that aren't UTF-8 become replacement characters."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace")


_CODERS: dict[int, PieceCoder] = {}


def _coder(model: bytes) -> PieceCoder:
    if (key := hash(model)) not in _CODERS:
        _CODERS[key] = PieceCoder(model)
    return _CODERS[key]


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with ids (array of int), n_ids and, with ``check``, decoded_equal: whether decoding gives the text again.

    The driver reads the model (under a megabyte) and sends it along. Null and empty texts have no ids; a null decodes as
    empty. Texts are encoded whole, whatever their length. Columns of the names added are replaced.
    """
    with open(model_path, "rb") as f:
        model = ship(docs.sparkSession).sparkContext.broadcast(f.read())
    base = docs.drop("ids", "n_ids", "decoded_equal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
                packed = [coder.encode_raw(t) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
                flat = np.frombuffer(b"".join(packed), np.int32)
                columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__text"]
                columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.diff(offsets).astype(np.int64))]
                if check:
                    back = coder.decode_all(flat, offsets[1:])
                    columns.append(pa.array([x == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(back, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names=[*(n for n in batch.schema.names if n != "__text"), "ids", "n_ids", *["decoded_equal"] * check])

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), *[T.StructField("decoded_equal", T.BooleanType())] * check]
    schema = T.StructType([*base.schema.fields, *added])
    return base.withColumn("__text", F.col(text_col)).mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col``; a null list gives a null."""
    with open(model_path, "rb") as f:
        model = ship(rows.sparkSession).sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(model.value)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else coder.decode(list(x)))

    return rows.withColumn(out_col, texts(F.col(ids_col)))
