"""SentencePiece encoding and decoding (operator 10): an Aho-Corasick automaton drives one Viterbi pass.

The automaton holds every ordinary piece of the model.  Reading a text once, it reports at each position all
pieces that end there (following its output links), and each of them relaxes the best score of that position:
best[end] = max(best[end - length] + score).  Characters that no piece ends on cost the smallest score minus
10 and are spelled with byte pieces, so every text has a path and decoding gives back exactly the text.
Ties keep the longest last piece.

Spaces become U+2581 behind one added leading space.  No piece of the supported models has U+2581 after
another character (checked when a model is loaded), so the best path of a text is the best paths of its
space-led chunks in a row, and equal chunks are solved once per worker (bounded cache).  A U+2581 in the
text itself is spelled in bytes, which keeps the round trip exact.  Control pieces are never matched.

Null text: null ids, and back.  Empty text: no ids.  Ids that no text is encoded to decode as well: an id that the model
does not have, or a null, becomes U+FFFD, bytes that are not UTF-8 likewise, and a leading space is dropped only if there
is one.  Rows are independent: no shuffle, repeated rows get
equal ids.  The model file is read on the driver and its pieces (a vocabulary, bounded) are broadcast.
"""

from __future__ import annotations

import re
import uuid
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "\u2581"
_HIDDEN = "\uffff"                      # stands for a literal U+2581 while matching; in no piece
_LOST = "\ufffd".encode()             # stands for an id that the model does not have
CACHE = 150_000
STEP = 500                      # rows handled at a time


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict:
    """{"pieces": [(text, score, kind)], "lead": add a leading space} with kind n(ormal), b(yte) or -."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(m.get_piece_size()):
        special = m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        out.append((m.id_to_piece(i), float(m.get_score(i)), "-" if special else "b" if m.is_byte(i) else "n"))
    if sum(k == "b" for _, _, k in out) != 256:
        raise ValueError(f"{path}: byte pieces are needed for an exact round trip")
    if any(re.search(f"[^{SPACE}]{SPACE}|{_HIDDEN}", p) for p, _, k in out if k == "n"):
        raise ValueError(f"{path}: a piece crosses a space")
    return {"pieces": out}


class Codec:
    """Encoder and decoder of one model, built once per worker; the automaton only where something is encoded."""

    def __init__(self, model: dict):
        self.model = model
        self.byte = [0] * 256
        self.out = []
        for i, (p, _, k) in enumerate(model["pieces"]):
            if k == "b":
                self.byte[int(p[3:5], 16)] = i
                self.out.append(bytes([int(p[3:5], 16)]))
            else:
                self.out.append(p.replace(SPACE, " ").encode() if k == "n" else b"")

    @cached_property
    def auto(self):
        import ahocorasick
        auto = ahocorasick.Automaton()
        for i, (p, s, k) in enumerate(self.model["pieces"]):
            if k == "n":
                auto.add_word(p, (len(p), s, i))
        auto.make_automaton()
        return auto

    @cached_property
    def unknown(self) -> float:
        return min(s for _, s, k in self.model["pieces"] if k == "n") - 10.0

    @cached_property
    def chunks(self):
        broken = any("\n" in p for p, _, k in self.model["pieces"] if k == "n")
        return re.compile(r" *[^ ]+| +" if broken else r" *[^ \n]+|\n| +").findall

    @cached_property
    def known(self) -> dict:
        """Ids of chunks that were solved before (at most CACHE of them).  When half of these are new, the older half
        goes, but for what occurred since, so frequent chunks stay."""
        codec = self

        class Known(dict):
            older: dict = {}

            def __missing__(self, chunk):
                ids = self.older.get(chunk)
                if ids is None:
                    ids = codec.solve(chunk)
                if len(self) >= CACHE // 2:
                    self.older = dict(self)
                    self.clear()
                if len(chunk) <= 64:
                    self[chunk] = ids
                return ids
        return Known()

    def solve(self, chunk: str) -> bytes:
        """Ids of one chunk, as int32 bytes."""
        text = chunk.replace(SPACE, _HIDDEN).replace(" ", SPACE)
        n = len(text)
        best = [0.0] + [None] * n
        back = [None] * (n + 1)

        def close(upto):                                 # positions no piece ends on, up to one that is asked for
            at = upto
            while best[at] is None:
                at -= 1
            for at in range(at + 1, upto + 1):
                best[at], back[at] = best[at - 1] + self.unknown, (1, 0.0, -1)

        for end, piece in self.auto.iter(text):          # by rising end, so what ends before it is final
            end += 1
            s = best[end - piece[0]]
            if s is None:
                close(end - piece[0])
                s = best[end - piece[0]]
            s += piece[1]
            b = best[end]
            if b is None or s > b:
                best[end], back[end] = s, piece
        if best[n] is None:
            close(n)
        path = []
        while n:
            length, _, i = back[n]
            n -= length
            if i >= 0:
                path.append(i)
            else:
                path.extend([self.byte[b] for b in chunk[n].encode()[::-1]])
        path.reverse()
        return array("i", path).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.chunks(" " + text))) if text else b""

    @cached_property
    def spelled(self) -> pa.Array:
        """Bytes of every id; the last entry stands for ids that the model does not have."""
        return pa.array([*self.out, _LOST], pa.binary())

    def decode_rows(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the rows ``ids[at[i]:at[i + 1]]``, spelled by one lookup for all."""
        n = len(self.out)
        got = self.spelled.take(pa.array(np.where((ids >= 0) & (ids < n), ids, n)))
        cut = np.frombuffer(got.buffers()[1], np.int32)[:len(got) + 1][at].tolist()
        body = got.buffers()[2]
        body = body.to_pybytes() if body is not None else b""
        texts = [body[a:z].decode(errors="replace") for a, z in zip(cut, cut[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        return self.decode_rows(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


_BUILT: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = Codec(shared.value)
    return _BUILT[shared.id]


class _Shared:
    """A broadcast model with an identity that survives pickling."""

    def __init__(self, spark, model):
        self.handle = spark.sparkContext.broadcast(model)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.handle.value


def share(spark, model_path: str | None = None) -> _Shared:
    return _Shared(spark, load_pieces(model_path or default_model()))


def _lists(parts: list[bytes | None]) -> pa.ListArray:
    sizes = np.array([len(p) // 4 if p else 0 for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p for p in parts if p), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([p is None for p in parts]))


def _with_column(df: DataFrame, name: str, kind: T.DataType, fill) -> DataFrame:
    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def batches(it):
        for b in it:
            for a in range(0, b.num_rows, STEP):                   # bounded Python objects at a time
                part = b.slice(a, STEP)
                yield pa.RecordBatch.from_arrays([*part.columns, fill(part)], names=[*part.schema.names, name])
    return df.mapInArrow(batches, schema)


def encode(df: DataFrame, model: _Shared, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the piece ids of ``text`` appended as array<int> (in place of a column of that
    name)."""
    def fill(b):
        codec = _codec(model)
        return _lists([None if t is None else codec.encode(t) for t in b[text].to_pylist()])
    return _with_column(df, out, T.ArrayType(T.IntegerType()), fill)


def decode(df: DataFrame, model: _Shared, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` appended."""
    def fill(b):
        codec, col = _codec(model), b[ids]
        at = col.offsets.to_numpy()
        flat, at = col.values[at[0]:at[-1]].fill_null(-1).to_numpy(zero_copy_only=False), at - at[0]
        return pa.array(codec.decode_rows(flat, at), pa.string(), mask=col.is_null().to_numpy(zero_copy_only=False))
    return _with_column(df, out, T.StringType(), fill)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids, 4 bytes each, low byte first), decoded_sha256, round_trip."""
    from ledgerlens.llm.common import table
    model = share(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    sha = F.sha2(F.col("decoded").cast("binary"), 256)

    def digest(it):
        import hashlib
        for b in it:
            col = b["ids"]
            at = col.offsets.to_numpy()
            flat, at = col.values[at[0]:at[-1]].to_numpy(zero_copy_only=False), at - at[0]
            null = col.is_null().to_pylist()
            cut = [b"" if n else flat[at[i]:at[i + 1]].tobytes() for i, n in enumerate(null)]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(c) // 4 for c in cut], pa.int64()),
                 pa.array([hashlib.sha256(c).hexdigest() for c in cut]), b["decoded_sha256"], b["round_trip"]],
                names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])
    return (decode(encode(docs, model), model)
            .select("doc_id", "ids", sha.alias("decoded_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))
            .mapInArrow(digest, schema))
