"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is the composition of three machines: the normaliser (a space becomes the meta symbol, one is put in
front), the pieces with byte fallback (one arc per piece; bytes where no piece has the character), and an acceptor of
pairs. The acceptor gives weight zero to neighbouring pieces that merging would have left apart and infinity to others,
so in the tropical semiring every prefix of an input has exactly one path of finite weight, which is the shortest one
and the merge encoding of the prefix. The search therefore keeps one state per position.

An arc never crosses from another character into a meta symbol, provided no piece does (checked when compiling), so a
text is composed word by word, and words already seen by a task are taken from a bounded memo. Batches are assembled
and decoded with numpy.

Defined results: a null or empty text has no pieces; invalid byte runs decode to U+FFFD; the meta symbol in a text comes
back as a space, as in the original; all other texts come back unchanged. Other columns are kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalake.llm.wordsets import slices

META = "▁"
#: Words and pairs of pieces that a task remembers.
MEMO = 800_000
PAIRS = 700_000


class Transducer:
    """A compiled model; ``path`` names a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.names = [model.id_to_piece(i) for i in ids]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        byte = [model.is_byte(i) for i in ids]
        self.arcs = {p: i for i, p in enumerate(self.names) if not special[i] and not byte[i]}
        self.cost = {p: -model.get_score(i) for p, i in self.arcs.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.names) if byte[i]}
        self.unknown = model.unk_id()
        self.by_word = not any(META in p.lstrip(META) for p in self.arcs)
        spelled = [
            b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(META, " ").encode()
            for i, p in enumerate(self.names)
        ]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        # arcs as a tree of characters: a node is (piece or None, next nodes); a piece that merging never makes has
        # infinite weight and is left out
        self.tree: dict[str, list] = {}
        for piece in self.arcs:
            if len(piece) == 1 or self._merged(piece) == [piece]:
                below, node = self.tree, []
                for char in piece:
                    node = below.setdefault(char, [None, {}])
                    below = node[1]
                node[0] = piece

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging the cheapest neighbouring pair first; defines the pair weights."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                cost = self.cost.get(parts[i] + parts[i + 1])
                if cost is not None and (best is None or cost < best):
                    best, at = cost, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stays(self, left: str, right: str) -> bool:
        """Weight zero of the pair acceptor."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left, right] = self._merged(left + right) == [left, right]
        return known

    def shortest(self, text: str) -> list[str]:
        """The pieces on the shortest path through the composition with a normalised string."""
        size = len(text)
        last: list[str | None] = [None] * (size + 1)
        tree, pairs, stays = self.tree, self.pairs, self._stays
        for start in range(size):
            left, below, end = last[start], tree, start
            if left is None and start:
                left = last[start] = text[start - 1]  # a character without a piece is an arc of its own
            for char in text[start:]:
                node = below.get(char)
                if node is None:
                    break
                piece, below = node
                end += 1
                if piece is not None and last[end] is None:
                    if left is None:
                        last[end] = piece
                    else:
                        zero = pairs.get((left, piece))
                        if zero or zero is None and stays(left, piece):
                            last[end] = piece
        if size and last[size] is None:
            last[size] = text[size - 1]
        path, end = [], size
        while end:
            path.append(last[end])
            end -= len(last[end])
        return path[::-1]

    def _ids(self, word: str) -> bytes:
        known = self.memo.get(word)
        if known is None:
            ids: list[int] = []
            for piece in self.shortest(word):
                if piece in self.arcs:
                    ids.append(self.arcs[piece])
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = np.array(ids, np.int32).tobytes()
            if len(word) <= 64:
                self.memo[word] = known
        return known

    def words(self, texts: pa.Array) -> pa.ListArray:
        """Each text cut where a meta symbol follows another character; runs of spaces stay with the next word."""
        if not self.by_word:
            return pa.LargeListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int64()), texts)
        plain = pc.replace_substring(texts, META, " ")
        odd = pc.or_(pc.match_substring(plain, "  "), pc.or_(pc.starts_with(plain, " "), pc.ends_with(plain, " ")))
        if not pc.any(odd).as_py():
            return pc.split_pattern(plain, " ")
        # a word is the text after its first space; further spaces before it stay at its front
        cut = []
        for text in plain.to_pylist():
            parts, out, held = text.split(" "), [], 0
            for part in parts[:-1]:
                if part:
                    out.append(" " * held + part)
                    held = 0
                else:
                    held += 1
            out.append(" " * held + parts[-1])
            cut.append(out)
        return pa.array(cut, pa.list_(texts.type))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, offsets of each text)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lists = self.words(texts)
        start = np.asarray(lists.offsets, dtype=np.int64)
        coded = pc.dictionary_encode(lists.values[start[0] : start[-1]])
        start = start - start[0]
        known = coded.dictionary.to_pylist()
        rows = [self._ids(META + w.replace(" ", META)) for w in known]
        codes = np.asarray(coded.indices, dtype=np.int64)
        size = np.array([len(r) // 4 for r in rows], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(rows), np.int32)
        # an empty text is one empty word: it has no pieces
        empty = np.repeat(np.asarray(pc.equal(pc.binary_length(texts), 0)), np.diff(start))
        n = np.where(empty, 0, size[codes])
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[:-1][codes] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[start]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts on end, offsets): the inverse machine, without the space put in front."""
        n = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        data = self.spelled[np.repeat(self.begins[ids] - ends[:-1], n) + np.arange(ends[-1])]
        places = ends[offsets]
        first = places[:-1][(np.diff(places) > 0)]
        first = first[data[first] == 32]
        keep = np.ones(len(data), bool)
        keep[first] = False
        gone = np.searchsorted(first, places)
        return data[keep], places - gone


@lru_cache(maxsize=4)
def compiled(path: str) -> Transducer:
    return Transducer(path)


def decoded_texts(machine: Transducer, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data, places = machine.decode(ids, offsets)
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
        return pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw))
    except UnicodeDecodeError:
        cuts = places.tolist()
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.array(parts, pa.large_string())


def _encoder(path: str):
    def run(batches):
        machine = compiled(path)
        for batch in batches:
            column = batch.schema.get_field_index("text")
            done = 0
            for texts in slices(batch.column(column)):
                ids, offsets = machine.encode(texts)
                back = decoded_texts(machine, ids, offsets)
                rows = batch.slice(done, len(texts))
                done += len(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                want = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), META, " ")
                yield pa.record_batch(
                    [*rows.columns, lists, pa.array(np.diff(offsets)), back.cast(pa.string()), pc.equal(back, want)],
                    names=[*rows.schema.names, "piece_ids", "n_pieces", "decoded", "round_trip"],
                )

    return run


ADDED = "piece_ids array<int>, n_pieces long, decoded string, round_trip boolean"


def encode_and_decode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with piece_ids, n_pieces, decoded (the text that the pieces spell) and round_trip.

    ``keep`` names the columns to carry along (all, if None) besides ``text``; columns of the four added names give way.
    """
    taken = {"piece_ids", "n_pieces", "decoded", "round_trip"}
    names = [c for c in docs.columns if c not in taken and (keep is None or c in keep or c == "text")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    added = T.StructType.fromDDL(ADDED)
    return rows.mapInArrow(_encoder(path), T.StructType([*rows.schema.fields, *added.fields]))
