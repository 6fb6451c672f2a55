"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary is a public SentencePiece BPE model; its file is a parameter, is read once on the driver
and is shipped with the task (its size is fixed). Encoding follows the model's own rules: a space in
front, spaces as U+2581, the highest-scored adjacent pair merged first, unknown characters as bytes.
Candidates wait in an agenda; when one is taken up, a hash keyed by the seed decides whether it is
skipped. With ``dropout`` 0 the ids are those of the library itself.

No piece of the vocabulary goes over a word start or holds a line end (checked when the model is loaded),
so texts are cut there and words are encoded apart. Each occurrence of a word has its own key, a hash keyed by
the seed over the text and the word's place in it; hashes of the key give the number of candidates kept before each
skip, which amounts to one draw for each candidate. So encodings are reproducible on any number of machines and
every occurrence of a word is segmented on its own, with no bound on the segmentations of a word. Within a slice,
occurrences that skip the same candidates of a word share one run of the agenda; the agendas of many words run side
by side as rows of arrays, those of words over ``LONG_WORD`` characters as heaps, with the same result.
Candidates of equal score are taken up from left to right.

Decoding is lossless for every text: U+2581 in a text goes to bytes, and decoded bytes are never
taken for spaces.

Defined cases: a null text is an empty one; an empty text has no ids and decodes to ''; equal texts have
equal ids; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from profusion.llm.common import int_lists, mix, new_names, slices, task

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
LONG_WORD = 48
#: Agendas that run side by side.
ROWS = 1 << 14
#: More candidates than any word has.
NEVER = 1 << 40
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPACE_MARK = "▁"
#: Codes of parts: pieces by their id, characters that only longer pieces hold from the vocabulary's size on, other characters below zero.
GONE = -(1 << 31)
_CHUNK = re.compile(f"\n|{SPACE_MARK}+[^{SPACE_MARK}\n]*|[^{SPACE_MARK}\n]+")


class Pairs:
    """Which two parts make a piece, its id and its rank (the higher the sooner, above 0), in an open hash table."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.key, self.piece, self.rank = np.full(size, NEVER << 20, np.uint64), np.full(size, GONE, np.int32), np.zeros(size, np.int32)
        piece, rank = (np.array([x[i] for x in pairs.values()], np.int32) for i in (0, 1))
        at, left, self.reach = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.reach += 1
            spot = at[left]
            free = self.key[spot] == np.uint64(NEVER << 20)
            first = np.zeros(len(left), bool)
            first[np.unique(spot, return_index=True)[1]] = True
            put = free & first
            self.key[spot[put]], self.piece[spot[put]], self.rank[spot[put]] = keys[left[put]], piece[left[put]], rank[left[put]]
            left = left[~put]
            at[left] = at[left] + 1 & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys * FACTOR
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(11) & self.mask).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair of parts; rank 0 if they make none."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).view(np.uint64)
        at = self._slot(keys)
        found = self.key[at]
        odd = np.flatnonzero((found != keys) & (found != np.uint64(NEVER << 20)))
        for _ in range(self.reach):
            if not len(odd):
                break
            at[odd] = at[odd] + 1 & int(self.mask)
            found = self.key[at[odd]]
            odd = odd[(found != keys[odd]) & (found != np.uint64(NEVER << 20))]
        hit = (self.key[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.piece[at], GONE), np.where(hit, self.rank[at], 0)


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece BPE model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        set_plain = set(plain)
        self.piece = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model needs byte pieces to be lossless")
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.piece):
            raise ValueError("a piece goes over a word start")
        if any("\n" in p for p in self.piece):
            raise ValueError("a piece holds a line end")
        self.raw = [sp.id_to_piece(i).replace(SPACE_MARK, " ").encode() if i in set_plain else b"" for i in range(size)]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.prepare(size)

    def prepare(self, size: int) -> None:
        """The codes of characters and the table of pairs."""
        chars = sorted({c for p in self.piece for c in p})
        self.code = {c: self.piece.get(c, size + k) for k, c in enumerate(chars)}
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for c, k in self.code.items():
            self.of_char[ord(c)] = k
        self.size, self.char = size, np.zeros(len(chars), np.int64)
        self.char[:] = [ord(c) for c in chars]
        order = {x: k for k, x in enumerate(sorted(set(self.score.values())), 1)}
        number = self.code | self.piece
        pairs = {}
        for p, i in self.piece.items():
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i, order[self.score[p]]
        self.pairs = Pairs(pairs)
        self.byte_id = np.array([self.byte.get(b, 0) for b in range(256)], np.int32)


class Codec:
    """Encodes and decodes. Candidates are numbered as they are taken up; which an occurrence skips follows from its key alone."""

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int):
        self.v, self.dropout, self.seed = vocabulary, dropout, seed
        #: The logarithm of the probability that a candidate is not skipped.
        self.stay = math.log1p(-dropout) if dropout < 1 else -math.inf
        self._pieces: pa.Array | None = None

    def _gaps(self, keys: np.ndarray, turn: int | np.ndarray) -> np.ndarray:
        """How many candidates are kept before the next skip: geometric, as with one draw for each candidate."""
        if self.dropout <= 0:
            return np.full(len(keys), NEVER)
        u = ((mix(keys + np.asarray(turn).astype(np.uint64) * FACTOR) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        return np.minimum(np.log(u) / self.stay, float(NEVER)).astype(np.int64)

    def _skips(self, key: int) -> Iterator[int]:
        """The numbers of the skipped candidates, without end."""
        at, turn, many = -1, 0, 16
        while True:
            places = at + np.cumsum(np.minimum(self._gaps(np.full(many, key, np.uint64), turn + np.arange(many)), NEVER // many) + 1)
            yield from places.tolist()
            at, turn, many = int(places[-1]), turn + many, min(2 * many, 4096)

    def encode_word(self, word: str, key: int) -> list[int]:
        """One word by itself, with a heap as its agenda. Positions are those of the parts' first characters."""
        score, n, skips = self.v.score, len(word), self._skips(key)
        taken, skip = 0, next(skips)
        part: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-score[x], i, x) for i in range(n - 1) if (x := word[i : i + 2]) in score]
        heapq.heapify(agenda)

        def offer(i: int, both: str) -> None:
            if both in score:
                heapq.heappush(agenda, (-score[both], i, both))

        while agenda:
            _, i, whole = heapq.heappop(agenda)
            left, j = part[i], after[i]
            if left is None or j >= n or left + part[j] != whole:
                continue  # one of its parts has gone into another merge
            taken += 1
            if taken > skip:
                skip = next(skips)
                continue
            part[i], part[j] = whole, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                offer(i, whole + part[k])
            if before[i] >= 0:
                offer(before[i], part[before[i]] + whole)
        piece = self.v.piece
        return [i for x in part if x is not None for i in ([piece[x]] if x in piece else [self.v.byte[b] for b in x.encode("utf-8", "surrogatepass")])]

    def _run(self, part: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Run the agendas of many words, one a row: merges in ``part`` (codes, padded with GONE), and the candidates taken up.

        ``skips``: the numbers of each row's skipped candidates, rising.
        """
        n, width = part.shape
        part = np.hstack([part, np.full((n, 1), GONE, np.int32)])
        width += 1
        whole, rank = (x.reshape(n, width - 1) for x in self.v.pairs.find(part[:, :-1].ravel(), part[:, 1:].ravel()))
        whole, rank = np.hstack([whole, np.full((n, 1), GONE, np.int32)]), np.hstack([rank, np.zeros((n, 1), np.int32)])
        after, before = (np.tile(np.arange(width, dtype=np.int32) + d, n) for d in (1, -1))
        after[width - 1 :: width] = width - 1
        code, whole = part.ravel(), whole.ravel()
        skips = np.hstack([skips, np.full((n, 1), NEVER, np.int64)])
        turn, skip, taken = np.zeros(n, np.int64), skips[:, 0].copy(), np.zeros(n, np.int64)
        rows = np.arange(n)
        while len(rows):
            i = rank.argmax(axis=1)
            live = np.flatnonzero(rank[np.arange(len(rows)), i])
            if len(live) < len(rows):  # agendas that have ended leave
                rank, rows, i = rank[live], rows[live], i[live]
                if not len(rows):
                    break
            flat = rank.ravel()
            own = np.arange(len(rows)) * width
            drop = taken[rows] == skip[rows]
            taken[rows] += 1
            if drop.any():
                out = rows[drop]
                flat[own[drop] + i[drop]] = 0
                turn[out] += 1
                skip[out] = skips[out, turn[out]]
                keep = ~drop
                row, own, i = rows[keep], own[keep], i[keep]
            else:
                row = rows
            base = row * width
            at = base + i
            j = after[at]
            new, k = whole[at], after[base + j]
            code[at], code[base + j] = new, GONE
            flat[own + j] = 0
            after[at], before[base + k] = k, i
            whole[at], flat[own + i] = self.v.pairs.find(new, code[base + k])
            h = before[at]
            some = h >= 0
            base, own, h, new = base[some], own[some], h[some], new[some]
            whole[base + h], flat[own + h] = self.v.pairs.find(code[base + h], new)
        part[:, :] = code.reshape(n, width)
        return part, taken

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of codes, characters that are no pieces as bytes, and how many ids each code has."""
        odd = np.flatnonzero((codes < 0) | (codes >= self.v.size))
        many = np.ones(len(codes), np.int64)
        if not len(odd):
            return codes, many
        c = codes[odd].astype(np.int64)
        point = np.where(c < 0, -1 - c, self.v.char[np.maximum(c - self.v.size, 0)])
        many[odd] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        out = np.repeat(codes, many)
        raw = "".join(map(chr, point.tolist())).encode("utf-8", "surrogatepass")
        out[np.repeat((codes < 0) | (codes >= self.v.size), many)] = self.v.byte_id[np.frombuffer(raw, np.uint8)]
        return out, many

    def _segmented(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end, how many, and the candidates taken up, of words chars[start : start + size] with their skips."""
        order = np.argsort(size, kind="stable")
        parts, many, taken = [], np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for a in range(0, len(order), ROWS):
            own = order[a : a + ROWS]
            n = size[own]
            part = np.full((len(own), int(n.max(initial=1))), GONE, np.int32)
            row = np.repeat(np.arange(len(own)), n)
            column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            part[row, column] = chars[start[own][row] + column]
            part, taken[own] = self._run(part, skips[own])
            there = part != GONE
            ids, each = self._ids(part[there])
            parts.append(ids)
            many[own] = np.bincount(np.repeat(np.arange(len(own)), there.sum(axis=1)), each, len(own)).astype(np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begin = np.zeros(len(size), np.int64)
        begin[order] = np.cumsum(many[order]) - many[order]
        return _gather(flat, begin, many), many, taken

    def _occurrences(self, words: list[str], which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the occurrences (the word words[which], its key) end to end, and how many each has.

        A way is a word and the numbers of its skipped candidates. Occurrences start without skips; in each
        turn those whose next skip is among the candidates their way takes up go on to the way with it.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        long = size > LONG_WORD
        short = ["" if far else w for w, far in zip(words, long.tolist(), strict=True)]
        chars = self.v.of_char[np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = np.where(long, 0, size)
        start = np.cumsum(size) - size
        skips = np.zeros((len(words), 0), np.int64)
        flat, many, taken = self._segmented(chars, start, size, skips)
        flats, counts, base = [flat], [many], len(words)
        mine, word = which.copy(), np.arange(len(words))
        if long.any():  # their skips are drawn as they are encoded
            far = np.flatnonzero(long[which])
            coded = [self.encode_word(words[w], int(k)) for w, k in zip(which[far].tolist(), keys[far].tolist(), strict=True)]
            flats.append(np.fromiter(chain.from_iterable(coded), np.int32))
            counts.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            mine[far] = base + np.arange(len(far))
            base += len(far)
        live, turn, first = np.flatnonzero(~long[which]), 0, 0
        place = np.full(len(live), -1)
        while len(live):
            place = place + 1 + self._gaps(keys[live], turn)
            more = place < taken[mine[live] - first]
            live, place, turn = live[more], place[more], turn + 1
            if not len(live):
                break
            span = int(place.max()) + 1
            new, at = np.unique((mine[live] - first) * span + place, return_inverse=True)
            old = new // span
            word, skips = word[old], np.hstack([skips[old], (new % span)[:, None]])
            flat, many, taken = self._segmented(chars, start[word], size[word], skips)
            flats.append(flat)
            counts.append(many)
            first, base = base, base + len(new)
            mine[live] = first + at
        every = np.concatenate(counts)
        own = every[mine]
        return _gather(np.concatenate(flats), (np.cumsum(every) - every)[mine], own), own

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text without U+2581, each with its leading spaces as U+2581; line ends are words."""
        if "  " in text or text.startswith(" "):
            return _CHUNK.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))
        parts = f" {text}".replace(" ", f" {SPACE_MARK}").replace("\n", " \n ").split(" ")
        return [w for w in parts if w]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if SPACE_MARK not in text:
            return self._encode_words(self.words(text), text)[0].tolist()
        # U+2581 itself goes to bytes, the words between as usual.
        runs = re.split(f"({SPACE_MARK})", " " + text)
        cut = [None if run == SPACE_MARK else _CHUNK.findall(run.replace(" ", SPACE_MARK)) for run in runs]
        flat, many = self._encode_words([w for words in cut for w in words or ()], text)
        ids, count = iter(flat.tolist()), iter(many.tolist())
        mark = [self.v.byte[b] for b in SPACE_MARK.encode()]
        return [i for words in cut for i in (mark if words is None else islice(ids, sum(islice(count, len(words)))))]

    def _encode_words(self, words: list[str], text: str) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        keys = mix(np.uint64(self._start(text)) + np.arange(len(words), dtype=np.uint64))
        return self._occurrences(list(number), which, keys)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts, end to end, and the texts' offsets. Each distinct word with its skips is looked up once."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, SPACE_MARK), pc.equal(texts, "")))
        marked = pc.replace_substring(pc.replace_substring(pc.binary_join_element_wise("", texts, " "), " ", f" {SPACE_MARK}"), "\n", " \n ")
        parts = pc.split_pattern(pc.if_else(odd, "", marked), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
        coded = pc.dictionary_encode(words.filter(pa.array(full)))
        n = np.diff(offsets)
        starts = np.fromiter((self._start(t) for t in texts.to_pylist()), np.uint64, len(texts))
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
        keys = mix(np.repeat(starts, n) + place.astype(np.uint64))
        out, own = self._occurrences(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), keys)
        cut = np.concatenate([[0], np.cumsum(own)])[offsets]
        rest = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rest):
            more = {i: np.array(self.encode(texts[i].as_py()), np.int32) for i in rest.tolist()}
            rows = [more[i] if i in more else out[cut[i] : cut[i + 1]] for i in range(len(texts))]
            out, cut = np.concatenate(rows), np.concatenate([[0], np.cumsum(list(map(len, rows)))])
        return out, cut

    def _start(self, text: str) -> int:
        return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed)

    def lossless(self, ids: np.ndarray, cut: np.ndarray, texts: pa.Array) -> pa.Array:
        """Whether ids, end to end with offsets, decode to the texts: their pieces are joined and the bytes compared."""
        if self._pieces is None:
            self._pieces = pa.array(self.v.raw, pa.binary())
        parts = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), self._pieces.take(pa.array(ids)))
        texts = pc.fill_null(texts, "")
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(""), texts, " "))  # every encoding begins with a space
        return pc.equal(pc.binary_join(parts, pa.scalar(b"", pa.binary())), spaced.cast(pa.binary()))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.v.raw[i] for i in ids)[1:].decode("utf-8", "replace")


def _gather(flat: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """flat[start : start + many] of each, end to end."""
    return flat[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]


_codecs: dict[tuple, Codec] = {}


def _codec(model: bytes, *settings) -> Codec:
    key = (xxhash.xxh3_64_intdigest(model), *settings)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary(model), *settings)
    return _codecs[key]


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, verify: bool = True) -> DataFrame:
    """``docs`` with ids (array of int), n_tokens (long) and, if ``verify``, lossless (boolean: decoding gives the text; ``new_names``)."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    ids, n_tokens, lossless = new_names(docs, "ids", "n_tokens", "lossless")
    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(n_tokens, T.LongType())] + [T.StructField(lossless, T.BooleanType())] * verify
    rest = docs.schema.fields
    schema = T.StructType(rest + new)
    arrow = to_arrow_schema(schema)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, dropout, seed)
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, cut = codec.encode_all(batch.column("text"))
                more = []
                if verify:
                    more = [codec.lossless(flat, cut, batch.column("text"))]
                lists = int_lists(flat, cut, pa.int32()).cast(arrow.field(ids).type)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(arrow.field(f.name).type) for f in rest), lists, pa.array(np.diff(cut)), *more], schema=arrow)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column decoded (string; ``new_names``) from the column ``ids``; null ids give ''."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    rest = encoded.schema.fields
    schema = T.StructType([*rest, T.StructField(new_names(encoded, "decoded")[0], T.StringType())])
    arrow = to_arrow_schema(schema)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, 0.0, SEED)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(ids).to_pylist()]  # not valid UTF-8: U+FFFD
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(arrow.field(f.name).type) for f in rest), pa.array(texts, pa.string())], schema=arrow)

    return encoded.mapInArrow(run, schema)
