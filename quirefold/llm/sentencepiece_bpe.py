"""SentencePiece BPE by the merge-type prefix table.

Every prefix of a text has one last token: that of the prefix's own encoding. The table keeps it per
position. At each end position an automaton over the vocabulary names the tokens that end there, and
a candidate is the last token exactly if it is compatible with the last token of the prefix before it:
if the pair, encoded on its own, stays a pair. (No merge crosses a final boundary, so both sides of it
merge as if alone, and the first merge that would cross the boundary involves only the two tokens that
touch it.) The ids are then read off backwards. The work is linear in the text; nothing is re-merged.

A text splits at places that no vocabulary piece crosses (before a word mark, around a line
end, before punctuation that no piece carries behind a letter); the parts are encoded once and memoised.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Memo, worker_state

MARK = "▁"  # fixed value: SentencePiece's sign for a space
#: ASCII punctuation at which a text may split, if the vocabulary allows it.
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Vocabulary, automaton and memoised encoder of one BPE model file."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are supported")
        if not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that mark spaces before words are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.raw: list[bytes] = []
        self.text: list[str] = []
        self.kind: list[int] = []
        self.unk = 0
        for i, p in enumerate(proto.pieces):
            self.kind.append(p.type)
            self.text.append(p.piece)
            self.raw.append(b"")
            if p.type in (1, 4, 5):
                self.score[p.piece], self.ids[p.piece] = p.score, i
                self.raw[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == 6:
                byte = int(p.piece[1:-1], 16)
                self.byte_ids[byte], self.raw[i] = i, bytes([byte])
            elif p.type == 2:
                self.unk, self.raw[i] = i, " ⁇ ".encode()
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.decimal = [str(i) for i in range(len(self.raw))]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self._merge(piece) == [piece]:  # others never come out of an encoding
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.splitter = re.compile(self._split_pattern())
        self.pairs: Memo = Memo(self._compatible)
        self.parts: Memo = Memo(self._encode_part)

    def _split_pattern(self) -> str:
        bigrams = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b[1] == MARK and b[0] != MARK for b in bigrams) or any("\n" in b for b in bigrams):
            return r"(?s:.+)"
        loose = set(PUNCTUATION)
        while bad := {b[1] for b in bigrams if b[1] in loose and b[0] not in loose and b[0] != MARK}:
            loose -= bad
        sign = "".join(map(re.escape, sorted(loose)))
        if not sign:
            return rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
        return rf"{MARK}*(?:[^{MARK}\n{sign}]+|[{sign}]+[^{MARK}\n{sign}]*)|{MARK}+|\n"

    def _merge(self, text: str) -> list[str]:
        """Best-score-first merging, leftmost on ties: the definition, used on single pieces and pairs."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, parts[a] + parts[b]))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def _compatible(self, pair: int) -> bool:
        left, right = self.text[pair >> 32], self.text[pair & 0xFFFFFFFF]
        return self._merge(left + right) == [left, right]

    def _spell(self, char: str) -> tuple[int, ...]:
        """Ids of a character outside the vocabulary."""
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_fallback else (self.unk,)

    def _encode_part(self, part: str) -> tuple[int, ...]:
        n = len(part)
        last, size = [-1] * n, [1] * n
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(part):
            if last[end] >= 0:
                continue
            start = end - length
            if start < 0 or last[start] < 0 or pairs[last[start] << 32 | token]:
                last[end], size[end] = token, length
        ids: list[int] = []
        at = n - 1
        while at >= 0:
            if last[at] >= 0:
                ids.append(last[at])
            else:  # no piece ends here: the character stands alone, and nothing merges with it
                ids.extend(reversed(self._spell(part[at])))
            at -= size[at]
        ids.reverse()
        if not self.byte_fallback:  # the library joins neighbouring unknowns
            ids = [x for i, x in enumerate(ids) if x != self.unk or not i or ids[i - 1] != self.unk]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without begin or end ids."""
        if not text:
            return []
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return list(chain.from_iterable(map(self.parts.__getitem__, self.splitter.findall(marked))))

    def decode(self, ids: list[int]) -> str:
        """Text of ids. Bytes that form no UTF-8 become U+FFFD each, control ids nothing."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.dummy_prefix and ids and self.kind[ids[0]] == 1 and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            pass
        out, at = [], 0
        while at < len(raw):
            for width in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + width].decode())
                    at += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def model_of(data: bytes) -> PieceModel:
    """One model per worker process."""
    return worker_state(("pieces", hashlib.sha256(data).digest()), lambda: PieceModel(data))


def read_model(path: str) -> bytes:
    """The model file, read by the driver; its size (about 0.5 MB) doesn't depend on the data."""
    with open(path, "rb") as f:
        return f.read()


def encode_column(docs: DataFrame, model: bytes, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Append the ids of a text column as array<int>. Narrow: no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        m = model_of(shipped.value)
        return pd.Series([m.encode(t) for t in texts], index=texts.index)

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode_column(frame: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append the text of an id array; null gives null."""
    shipped = frame.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        m = model_of(shipped.value)
        return pd.Series([None if r is None else m.decode(list(r)) for r in rows], index=rows.index)

    return frame.withColumn(out_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, every text: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null counts as empty and gives no ids. Repeated rows give repeated results; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def digests(batches):
        m = model_of(shipped.value)
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = m.encode(text)
                joined = ",".join(map(m.decimal.__getitem__, ids))
                rows.append((doc_id, len(ids), sha(joined.encode()).hexdigest(), sha(m.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.astype({"doc_id": "Int64"})

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return picked.mapInPandas(digests, SCHEMA)
