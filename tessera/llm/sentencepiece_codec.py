"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no vocabulary piece has a whitespace marker after another character, and none holds a line break, merges
never cross the border before a marker run or at a line break.  A text then falls into chunks (marker run with the
word after it), each distinct chunk is segmented once, and the chunks' ids are joined back by their place in the
text.  The table is per Python worker and bounded (`table_size`): one table for the corpus would send every word occurrence
of the corpus through a shuffle to be joined back.  A model that breaks the condition is encoded text by text.

Nulls: a null text is encoded as an empty one.  Empty text: the end id alone, decoded to "".  Repeated rows give
repeated results; further columns are kept; columns named as a result column are replaced.  An empty table gives no rows.  A text
of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free, kept, texts_of

_MARK = "▁"
_CHUNK = re.compile(r"[ ▁]*[^ ▁\n]+|[ ▁]+|\n")


class Codec:
    """encode(texts) -> [(ids as decimal strings, decoded text)] with a bounded table of chunks."""

    def __init__(self, model_path: str, table_size: int = 250_000, add_eos: bool = True):
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.eos = [str(self.whole.eos_id())] if add_eos else []
        self.size, self.table = table_size, {}
        self.part = self._bare(model_path) if self._cuttable() else None

    def _cuttable(self) -> bool:
        """The identity normalizer, a dummy prefix, and no piece that crosses a chunk's border."""
        sp = self.whole
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces):
            return False
        return all(
            sp.encode(x, out_type=str) == sp.encode(y, out_type=str)
            for x, y in (("a  b ", "a" + 2 * _MARK + "b" + _MARK), (" a", _MARK + "a"))
        ) and sp.decode(sp.encode("ﬁ x  ")) == "ﬁ x  "

    @staticmethod
    def _bare(model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False
        return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def _learn(self, chunks: list[str]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.table]
        if not new:
            return
        ids = self.part.encode(new, num_threads=1)
        decoded = self.part.decode(ids, num_threads=1)
        self.table.update((c, (len(i), " ".join(map(str, i)), d)) for c, i, d in zip(new, ids, decoded, strict=True))

    def __call__(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by a space, decoded text) of each text."""
        if self.part is None:
            out = []
            for t in texts:
                ids = self.whole.encode(t)
                out.append((len(ids) + len(self.eos), " ".join([*map(str, ids), *self.eos]), self.whole.decode(ids)))
            return out
        out = []
        for t in texts:
            if not t:
                out.append((len(self.eos), " ".join(self.eos), ""))
                continue
            chunks = _CHUNK.findall(_MARK + t)
            if len(self.table) > self.size:
                self.table.clear()
            try:
                got = [self.table[c] for c in chunks]
            except KeyError:
                self._learn(chunks)
                got = [self.table[c] for c in chunks]
            n = sum(g[0] for g in got) + len(self.eos)
            out.append((n, " ".join([*(g[1] for g in got), *self.eos]), "".join([g[2] for g in got])[1:]))
        return out


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", with_text: bool = False, table_size: int = 250_000, add_eos: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, and with with_text also ids (array<int>) and decoded."""
    keep = [f for f in docs.schema.fields if f.name not in {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"} and (with_text or f.name != text_col)]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_text:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept("piece", (model_path, table_size, add_eos), lambda: Codec(model_path, table_size, add_eos))
        for b in batches:
            at = b.num_columns - 1
            n, ids_hex, dec_hex, ids, decoded = [], [], [], [], []
            for lo in range(0, b.num_rows, 256):
                for count, joined, text in codec(texts_of(b.column(at).slice(lo, 256))):
                    n.append(count)
                    ids_hex.append(hashlib.sha256(joined.encode()).hexdigest())
                    dec_hex.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_text:
                        ids.append([int(x) for x in joined.split()])
                        decoded.append(text)
            cols = [b.column(b.schema.names.index(x)) for x in names] + [pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(dec_hex, pa.string())]
            out = [*names, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                out += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=out)

    return docs.select(*[F.col(f"`{x}`") for x in names], F.col(f"`{text_col}`").cast("string").alias(free("__text", names))).mapInArrow(run, schema)
