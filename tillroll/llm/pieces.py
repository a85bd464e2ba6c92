"""SentencePiece encoding and decoding: a batched numpy Viterbi over words.

A model file gives pieces and scores.  Text is split into words (a run of
``▁`` and what follows up to the next one; models with a piece that crosses
such a border are refused), distinct words of a batch are grouped by length,
and all words of a length advance together: for every end position and piece
length the substring's rolling hash probes the sorted piece keys, and the best
incoming score and its back-pointer are kept with vectorised maxima.

Two model types are supported, with the ids of the SentencePiece library:

* *unigram*: the score of a path is the sum of its pieces' scores;
* *BPE*: a path is allowed only if each two neighbouring pieces are the merges'
  own result for their joint text.  For a set of merges ordered by score, a
  path with that property is the BPE result, and each prefix of a word has
  exactly one, so the maximum over allowed paths finds it.  Whether a pair is
  allowed is worked out once per pair and task, by unwinding the merges on both
  sides of the border, for all new pairs of a step at once.

Characters outside the vocabulary fall back to byte pieces.  A null text
encodes to null, an empty one to no ids.  Decoding inverts encoding, but for
``▁`` itself, which the model has no way to tell from a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tillroll.llm.common import bounded_batches

SPACE = "▁"
CACHED_WORDS = 400_000
CACHED_PAIRS = 1 << 21
BATCH_BYTES = 6 << 20      # text that a task encodes at once
LONGEST_BATCHED = 64       # longer words are cut where no piece can cross

_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_B = np.uint64(0x9E3779B97F4A7C15)
_CODE = np.uint64(0xD1B54A32D192ED03)
_SPREAD = np.uint64(0xA0761D6478BD642F)
CELL_BITS = 19


class Vocabulary:
    """Pieces of a model as sorted hash arrays; plain arrays, so that it travels in a broadcast."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        self.byte_id = np.full(256, -1, np.int32)
        usable = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usable.append(i)
        self.unknown = sp.unk_id()
        crossing = [self.pieces[i] for i in usable if SPACE in self.pieces[i].lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces cross a word border: {crossing[:3]}")
        self.bpe = _model_type(model) == 2
        # what each id adds to a decoded text
        self.decoded = [p.replace(SPACE, " ").encode("utf-8") for p in self.pieces]
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                self.decoded[i] = b""
            elif sp.is_byte(i):
                self.decoded[i] = bytes([int(self.pieces[i][3:5], 16)])
        inner = {ord(a) << 21 | ord(b) for i in usable for a, b in zip(self.pieces[i], self.pieces[i][1:])}
        self.inner = np.array(sorted(inner), np.int64)
        self._sort(usable)
        if self.bpe:
            self._merges(usable)

    def _sort(self, usable: list[int]) -> None:
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.power = np.full(self.longest + 2, _B, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power, dtype=np.uint64)
        raw = np.array([_raw(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(raw * _SPREAD)
        self.keys, self.ids = raw[order], np.array(usable, np.int32)[order]
        if len(np.unique(raw)) < len(raw):
            raise ValueError("two pieces share a hash")
        # a directory over the top bits of the sorted keys narrows each search to a few of them
        cell = _cell(self.keys)
        self.head = np.full(1 << CELL_BITS, -1, np.int32)
        first = np.concatenate(([True], cell[1:] != cell[:-1]))
        self.head[cell[first]] = np.flatnonzero(first)
        self.most = int(np.diff(np.append(np.flatnonzero(first), len(cell))).max())

    def _merges(self, usable: list[int]) -> None:
        """For each piece the two it is merged from; pieces the merges never make are marked."""
        index = {self.pieces[i]: i for i in usable}
        n = len(self.pieces)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.made = np.zeros(n, bool)
        for i in usable:
            parts = list(self.pieces[i])
            while len(parts) > 2:
                best = max(((self.scores[index[a + b]], -j) for j, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in index),
                           default=None)
                if best is None:
                    break
                j = -best[1]
                parts[j:j + 2] = [parts[j] + parts[j + 1]]
            if len(parts) == 1:
                self.made[i] = True
            elif len(parts) == 2 and all(p in index for p in parts):
                self.made[i] = True
                self.left[i], self.right[i] = index[parts[0]], index[parts[1]]
        # rank of a piece's own merge: later merges have higher ranks, single characters come first
        self.rank = np.where(self.left >= 0, -self.scores, -1.0)
        self.length = np.array([len(p) for p in self.pieces], np.int32)
        self.hash = np.zeros(n, np.uint64)
        self.hash[self.ids] = self.keys

    def lookup(self, raw: np.ndarray) -> np.ndarray:
        """Piece ids of raw rolling hashes, -1 where there is none."""
        out = np.full(len(raw), -1, np.int32)
        some, ids = self.probe(raw)
        out[some] = ids
        return out

    def probe(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the substring hashes are pieces, and which."""
        at = self.head[_cell(raw)]
        some = np.flatnonzero(at >= 0)
        at, want = at[some], raw[some]
        found = self.keys[at] == want
        for step in range(1, self.most):
            # the next keys of the same cell
            rest = np.flatnonzero(~found)
            ahead = np.minimum(at[rest] + 1, len(self.keys) - 1)
            at[rest] = ahead
            found[rest] = self.keys[ahead] == want[rest]
        return some[found], self.ids[at[found]]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that is ``a`` followed by ``b``, or -1."""
        fits = self.length[a] + self.length[b] <= self.longest
        out = np.full(len(a), -1, np.int32)
        if fits.any():
            x, y = a[fits], b[fits]
            raw = self.hash[x] * self.power[self.length[y]] + self.hash[y]
            out[fits] = self.lookup(raw)
        return out

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of the joint text of two pieces leave exactly these two.

        Merges run in the order of rank, and of equal rank from the left.  At
        any time the pieces at the border are ``x`` (left) and ``y`` (right);
        undoing the merges from the last one, the border pair may not have
        merged before the next merge on either side took place.
        """
        ok = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), np.inf)     # rank of the merge that was just undone
        left_next = np.zeros(len(a), bool)  # it was on the right: a border merge of equal rank would come first
        live = np.arange(len(a))
        while len(live):
            cx, cy = x[live], y[live]
            border = self.merged(cx, cy)
            rank = np.where(border >= 0, -self.scores[border], np.inf)
            early = (rank < limit[live]) | ((rank == limit[live]) & left_next[live] & (border >= 0))
            ok[live[early]] = False
            rx, ry = self.rank[cx], self.rank[cy]
            open_ = ~early & ((rx >= 0) | (ry >= 0))
            live, cx, cy, rx, ry = live[open_], cx[open_], cy[open_], rx[open_], ry[open_]
            # the later merge is undone first; of equal rank, the right one is later
            on_left = rx > ry
            limit[live] = np.where(on_left, rx, ry)
            left_next[live] = ~on_left
            x[live] = np.where(on_left, self.right[cx], cx)
            y[live] = np.where(on_left, cy, self.left[cy])
        return ok


def _model_type(model: bytes) -> int:
    """``trainer_spec.model_type`` of a model file: 1 unigram (also the default), 2 BPE."""
    def varint(at):
        value = shift = 0
        while True:
            byte = model[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    def fields(at, end):
        while at < end:
            tag, at = varint(at)
            kind = tag & 7
            if kind == 0:
                value, at = varint(at)
            else:
                size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
                value, at = (at, at + size), at + size
            yield tag >> 3, value

    for field, value in fields(0, len(model)):
        if field == 2:
            return next((v for f, v in fields(*value) if f == 3), 1)
    return 1


def _raw(text: str) -> int:
    """Rolling hash of a text."""
    raw = 0
    for c in text:
        raw = (raw * int(_B) + (ord(c) + 1) * int(_CODE)) & (1 << 64) - 1
    return raw


def _cell(raw: np.ndarray) -> np.ndarray:
    return (raw * _SPREAD >> np.uint64(64 - CELL_BITS)).view(np.int64)


def _words(text: str) -> list[str]:
    """The words of a text behind the leading space that encoding adds."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")  # the same, faster
    return _WORD.findall(SPACE + text.replace(" ", SPACE))


class Encoder:
    """Encodes texts in one task; keeps bounded caches of words and pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        # a direct-mapped cache: a pair overwrites what shares its cell
        self.pair_keys = np.full(CACHED_PAIRS, -1, np.int64)
        self.pair_ok = np.zeros(CACHED_PAIRS, bool)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        cell = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 21)).view(np.int64)
        ok = self.pair_ok[cell]
        miss = np.flatnonzero(self.pair_keys[cell] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            ok[miss] = self.v.allowed((new >> 32).astype(np.int32), (new & 0xFFFFFFFF).astype(np.int32))[back]
            # in order, so that key and verdict come from the same pair
            last = np.unique(cell[miss][::-1], return_index=True)[1]
            kept = miss[::-1][last]
            self.pair_keys[cell[kept]], self.pair_ok[cell[kept]] = key[kept], ok[kept]
        return ok

    def _same_length(self, words: list[str], size: int) -> list[bytes]:
        """Ids (32 bits each) of words of ``size`` characters, all advancing together."""
        v, n = self.v, len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T
        code = (chars.astype(np.uint64) + np.uint64(1)) * _CODE
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _B + code[i]
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        step = np.zeros((size + 1, n), np.int32)
        last = np.full((size + 1, n), -1, np.int32)
        least = float(v.scores.min(initial=0)) - 10
        for end in range(1, size + 1):
            for length in range(1, min(end, v.longest) + 1):
                start = end - length
                at, ids = v.probe(prefix[end] - prefix[start] * v.power[length] if start else prefix[end])
                if not len(at):
                    continue
                if v.bpe:
                    fits = v.made[ids]
                    before = last[start][at]
                    ask = np.flatnonzero(fits & (before >= 0))
                    if len(ask):
                        fits[ask] = self._pairs(before[ask], ids[ask])
                    at, ids = at[fits], ids[fits]
                    score = best[start][at]
                else:
                    score = best[start][at] + v.scores[ids]
                better = score > best[end][at]
                at = at[better]
                best[end][at], last[end][at], step[end][at] = score[better], ids[better], length
            # a character that no piece covers stands alone: the complement of its code point
            alone = np.flatnonzero(v.lookup(code[end - 1]) < 0)
            if len(alone):
                score = best[end - 1][alone] + (0 if v.bpe else least)
                better = score > best[end][alone]
                at = alone[better]
                best[end][at], step[end][at] = score[better], 1
                last[end][at] = -1 - chars[end - 1][at].astype(np.int32)
        path = np.empty((n, size), np.int32)
        first, at, rows = np.full(n, size), np.full(n, size), np.arange(n)
        while len(rows):
            now = at[rows]
            first[rows] -= 1
            path[rows, first[rows]] = last[now, rows]
            at[rows] = now - step[now, rows]
            rows = rows[at[rows] > 0]
        flat = path[np.arange(size) >= first[:, None]]
        ends = np.concatenate(([0], np.cumsum(size - first))) * 4
        raw = flat.tobytes()
        out = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for r in np.flatnonzero(np.bincount(np.repeat(np.arange(n), size - first), weights=flat < 0, minlength=n)).tolist():
            out[r] = self._bytes(np.frombuffer(out[r], np.int32).tolist())
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        """Byte pieces (or the unknown piece) for the characters outside the vocabulary."""
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif (self.v.byte_id >= 0).all():
                out.extend(int(self.v.byte_id[b]) for b in chr(-1 - i).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.v.unknown)
        return np.array(out, np.int32).tobytes()

    def _learn(self, words: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, group in by_size.items():
            rows = max(1, (1 << 20) // (size + 1))
            for i in range(0, len(group), rows):
                part = group[i:i + rows]
                self.words.update(zip(part, self._same_length(part, size)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [None if t is None else _words(t) for t in texts]
        wanted = set().union(*(ws for ws in split if ws))
        long = {w: self._pieces_of(w) for w in wanted if len(w) > LONGEST_BATCHED}
        if long:
            split = [ws if not ws or long.keys().isdisjoint(ws) else [p for w in ws for p in long.get(w, (w,))] for ws in split]
            wanted = set().union(*(ws for ws in split if ws))
        new = wanted - self.words.keys()
        if len(self.words) + len(new) > CACHED_WORDS:
            # what this batch needs stays, so frequent words are never worked out again
            self.words = {w: self.words[w] for w in wanted - new}
        self._learn(new)
        find = self.words.__getitem__
        return [None if ws is None else np.frombuffer(b"".join(map(find, ws)), np.int32) for ws in split]

    def _pieces_of(self, word: str) -> list[str]:
        """Cuts a long word between characters that are neighbours in no piece."""
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = code[:-1] << 21 | code[1:]
        at = np.searchsorted(self.v.inner, pair)
        at[at == len(self.v.inner)] = 0
        cuts = (np.flatnonzero(self.v.inner[at] != pair) + 1).tolist() if len(self.v.inner) else range(1, len(word))
        cuts = [0, *cuts, len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def decode_lists(v: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """The texts of rows of ids: all pieces are gathered into one stream, which the rows' ends cut."""
    pieces = pc.take(pa.array(v.decoded, pa.large_binary()), ids.flatten())
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    cuts = ends[np.concatenate(([0], np.cumsum(sizes)))].tolist()
    stream = memoryview(pieces.buffers()[2] or b"")
    texts = [str(stream[a + (stream[a:a + 1] == b" "):b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
    return pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))


def decode_ids(v: Vocabulary, ids) -> str:
    """The text of one row of ids."""
    return decode_lists(v, pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py()


def read_model(spark, path: str) -> bytes:
    """A model file, local to the driver or in any store that Spark reads."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def encode(docs: DataFrame, model: bytes, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the piece ids of every whole text, ``ids array<int>``.

    The vocabulary (one model file) is broadcast.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    rows = docs.select(*names, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)

        def flush(held: list[pa.RecordBatch]):
            ids = encoder.encode([t for batch in held for t in batch.column("__text").to_pylist()])
            at = 0
            for batch in held:
                own, at = ids[at:at + batch.num_rows], at + batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), _lists(own)], [*names, "ids"])

        held, size = [], 0
        for batch in it:
            held.append(batch)
            size += batch.column("__text").nbytes
            if size >= BATCH_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(run, docs.select(*names).schema.add("ids", ArrayType(IntegerType())))


def _encoder(v: Vocabulary) -> Encoder:
    """One encoder per worker process: its caches outlive a task."""
    if not hasattr(v, "encoder"):
        v.encoder = Encoder(v)
    return v.encoder


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids])
    flat = np.concatenate([x for x in ids if x is not None]) if any(x is not None for x in ids) else np.zeros(0, np.int32)
    missing = pa.array([x is None for x in ids], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=missing)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``rows`` and the text of ``ids_col`` as ``decoded``; null ids give null."""
    bounded_batches(rows.sparkSession)
    names = [c for c in (rows.columns if keep is None else keep) if c != "decoded"]
    frame = rows.select(*names, F.col(ids_col).alias("__ids"))
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(it):
        v = shared.value
        for batch in it:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), decode_lists(v, batch.column("__ids"))], [*names, "decoded"])

    return frame.mapInArrow(run, rows.select(*names).schema.add("decoded", "string"))
