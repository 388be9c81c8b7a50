"""Encoding with merge-type vocabularies, and decoding.

A text is a list of symbols, one a code point. An agenda holds every two adjacent symbols
that make a piece of the vocabulary; the pair of the best score, and of such the leftmost,
is merged, and the pairs with its new neighbours join the agenda. What is no piece in the
end is spelt in bytes. Where no piece of the vocabulary goes on past a word's end, no merge
crosses one either: words are then merged apart. The texts of a batch are numbers of its different
words, each of which is merged once. Words of one length are merged together, a pair of each at a
time: the agenda is a column of ranks. Long and few ones are merged one by one and remembered.

Texts are encoded in Arrow batches, whole, and inside the same batches compared with what
the sentencepiece library makes of them: `agrees` says for each text whether ids and decoded
text are the library's.

Cases: a null text is empty and has no ids; rows that repeat are encoded each; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free, slices

#: White space in pieces.
MARK = "▁"
#: Words merged one by one that a worker remembers, twice over, of at most `LONGEST` code points:
#: when the newer half is full it becomes the older one, from which words that are met again come back.
HELD, LONGEST = 400_000, 64
#: Code points of a short text; above all scores.
SHORT, NONE = 32, float("inf")
#: Bits of a place in a short text, with one before its first and one after its last.
BITS = 6
#: Fewer words than these are merged one by one; more than those in turns.
TOGETHER, AT_ONCE = 24, 4096

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialized message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        else:
            size, i = number(i) if tag & 7 == 2 else (4 if tag & 7 == 5 else 8, i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Pairs:
    """Ranks of pairs of symbols (pieces, and code points of pieces), in a table by hash."""

    def __init__(self, normal: dict[str, int], ranks: dict[str, float]) -> None:
        symbols = list(dict.fromkeys(chain(normal, chain.from_iterable(normal))))
        place = {s: i for i, s in enumerate(symbols)}
        self.other = len(symbols)  # any code point that is in no piece
        self.number = self.other + 1
        #: By symbol, its id (-1: no piece); by code point, its symbol.
        self.ids = np.array([*(normal.get(s, -1) for s in symbols), -1], np.int32)
        self.of_code = np.full(0x110000, self.other, np.int64)
        for s in symbols:
            if len(s) == 1:
                self.of_code[ord(s)] = place[s]
        level = {x: i for i, x in enumerate(sorted(set(ranks.values())))}
        #: By rank what pairs make; -1 where several pieces have one rank.
        self.made = np.full(len(level), -1, np.int64)
        of = Counter(ranks[p] for p in normal)
        for p in normal:
            if of[ranks[p]] == 1:
                self.made[level[ranks[p]]] = place[p]
        pairs = [(place[p[:i]] * self.number + place[p[i:]], level[ranks[p]], place[p]) for p in normal for i in range(1, len(p)) if p[:i] in place and p[i:] in place]
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.none = len(level)
        self.keys = np.full(self.last + 1, -1, np.int64)
        self.ranks = np.full(self.last + 1, self.none, np.int32)
        self.both = np.zeros(self.last + 1, np.int64)
        for (key, rank, both), at in zip(pairs, self.slots(np.array([p[0] for p in pairs], np.int64)).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self.last
            self.keys[at], self.ranks[at], self.both[at] = key, rank, both

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where in the table pairs are; of those that make no piece, an empty place."""
        key = left * self.number + right
        at = self.slots(key)
        there = self.keys.take(at)
        far = np.flatnonzero((there != key) & (there >= 0))
        while len(far):
            at[far] = (at[far] + 1) & self.last
            there = self.keys[at[far]]
            far = far[(there != key[far]) & (there >= 0)]
        return at

    def merged(self, symbols: np.ndarray) -> np.ndarray:
        """Of texts of one length (a column each), the last symbols: each stays where it begins,
        and other places hold -1."""
        n, many = symbols.shape
        # At both ends a symbol that is in no pair.
        at = np.full((n + 2, many), self.other, np.int64)
        at[1:-1] = symbols
        place = np.arange(n + 2, dtype=np.int32)[:, None]
        before, after = (np.repeat(place + x, many, 1).ravel() for x in (-1, 1))
        # By place the rank of the pair that begins there, with the place in the last bits: the
        # least is the best pair, and of such the leftmost.
        agenda = self.ranks.take(self.places(at[:-1].ravel(), at[1:].ravel())).reshape(n + 1, many) << BITS | place[:-1]
        at, ranks, none = at.ravel(), agenda.ravel(), self.none << BITS
        while True:
            best = agenda.min(0)
            live = np.flatnonzero(best < none)
            if not len(live):
                return at.reshape(n + 2, many)[1:-1]
            best = best[live]
            left = (best & (1 << BITS) - 1) * many + live
            right = after.take(left) * many + live
            first, last = before.take(left), after.take(right)
            made = self.made.take(best >> BITS)
            if len(i := np.flatnonzero(made < 0)):
                made[i] = self.both.take(self.places(at[left[i]], at[right[i]]))
            at[left], at[right], ranks[right] = made, -1, none
            after[left], before[last * many + live] = last, best & (1 << BITS) - 1
            pairs = self.places(np.concatenate([at.take(first * many + live), made]), np.concatenate([made, at.take(last * many + live)]))
            new = self.ranks.take(pairs) << BITS
            ranks[first * many + live] = new[: len(live)] | first
            ranks[left] = new[len(live) :] | best & (1 << BITS) - 1


def flat(texts: list[Iterable[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts, and where each text's end."""
    return np.fromiter(chain.from_iterable(texts), np.int32), np.cumsum([0, *map(len, texts)])


class Batch:
    """Ids of the texts of a batch: those of its different words with where each word's end, the
    numbers of the words that texts have, and how many each text has."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, words: np.ndarray, counts: list[int]) -> None:
        self.ids, self.ends, self.words, self.counts = ids, ends, pa.array(words), np.cumsum([0, *counts])

    @classmethod
    def of_lists(cls, texts: list[Iterable[int]]) -> Batch:
        """Texts that are a word each."""
        return cls(*flat(texts), np.arange(len(texts)), [1] * len(texts))

    def laid(self, data: pa.Buffer, ends: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
        """The bytes of different words, put where texts have these; where texts end."""
        each = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), data])
        made = each.take(self.words)
        _, ends, data = made.buffers()
        return data or pa.py_buffer(b""), np.frombuffer(ends, np.int64, len(made) + 1)[self.counts] if len(made) else 0 * self.counts

    def joined(self, table: pa.Array) -> tuple[bytes, list[int]]:
        """What a table holds for each id, joined, and where texts end."""
        data, ends = self.laid(*taken(table, self.ids, self.ends))
        return data.to_pybytes(), ends.tolist()

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's end."""
        data, ends = self.laid(pa.py_buffer(self.ids), 4 * self.ends)
        return np.frombuffer(data, np.int32, ends[-1] // 4), ends // 4

    def texts(self) -> list[np.ndarray]:
        ids, ends = self.numbers()
        return [ids[i:j] for i, j in pairwise(ends.tolist())]


class Vocabulary:
    """Pieces, scores and kinds of a model file. Raises ValueError for models whose texts are
    not merged by score: other types, normalised texts, pieces that the user fixed."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        parts = list(fields(sp.serialized_model_proto()))
        trainer, normalizer = (dict(fields(dict(parts).get(k, b""))) for k in (2, 3))
        kinds = [dict(fields(v)).get(3, 1) for k, v in parts if k == 1]
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or set(kinds) - {1, 2, 3, 6}:
            raise ValueError(f"{path}: not a plain merge-type vocabulary")
        self.prefix = MARK if normalizer.get(3, 1) else ""
        pieces = [sp.id_to_piece(i) for i in range(len(kinds))]
        self.normal = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        self.silent = {i for i, kind in enumerate(kinds) if kind == 3}
        self.marked = {i for p, i in self.normal.items() if p[0] == MARK}
        self.ranks = {p: -sp.get_score(i) for p, i in self.normal.items()}
        self.unknown, self.bytes = sp.unk_id(), {}
        self.written: list[bytes] = []
        for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == 6:
                self.bytes[int(p[3:5], 16)] = i
            shown = {2: trainer.get(44, " ⁇ ".encode()), 3: b"", 6: bytes([int(p[3:5], 16)]) if kind == 6 else b""}
            self.written.append(shown.get(kind, p.replace(MARK, " ").encode()))
        #: By id, in one column, for texts in batches.
        self.shown = pa.array(self.written, pa.large_binary())
        self.digits = pa.array([b"%d," % i for i in range(len(pieces))], pa.large_binary())
        #: By byte, its id.
        self.of_byte = np.array([self.bytes.get(b, self.unknown) for b in range(256)], np.int32)
        self.words = None if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.normal) else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs = Pairs(self.normal, self.ranks)
        self.held: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> tuple[int, ...]:
        """The ids of a text whose white space is marked."""
        return self.ids_of(self.merged_word(text) if len(text) <= SHORT else self.merged_text(text))

    def merged_word(self, text: str) -> list[str]:
        """Of a short text the agenda is a list, from which the least is taken by looking."""
        get, symbols = self.ranks.get, list(text)
        agenda = [get(text[i : i + 2], NONE) for i in range(len(text) - 1)]
        while agenda:
            best = min(agenda)
            if best == NONE:
                break
            i = agenda.index(best)  # the leftmost
            both = symbols[i] + symbols.pop(i + 1)
            symbols[i] = both
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(both + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + both, NONE)
        return symbols

    def merged_text(self, text: str) -> list[str]:
        """Of any text, in time that grows little more than its length."""
        ranks, symbols, n = self.ranks, list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # Entries are (minus score, left, right, length of both).
        agenda = [(ranks[both], i, i + 1, 2) for i in range(n - 1) if (both := text[i : i + 2]) in ranks]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            both = symbols[left] + symbols[right]
            # A pair one of whose symbols was merged since is another pair by now.
            if len(both) != size or not symbols[left] or not symbols[right]:
                continue
            symbols[left], symbols[right] = both, ""
            last, first = after[right], before[left]
            after[left] = last
            if last < n:
                before[last] = left
                if (more := both + symbols[last]) in ranks:
                    heapq.heappush(agenda, (ranks[more], left, last, len(more)))
            if first >= 0 and (more := symbols[first] + both) in ranks:
                heapq.heappush(agenda, (ranks[more], first, left, len(more)))
        return [s for s in symbols if s]

    def ids_of(self, symbols: list[str]) -> tuple[int, ...]:
        ids = [*map(self.normal.get, symbols)]
        if None not in ids:
            return tuple(ids)
        return tuple(chain.from_iterable((i,) if i is not None else self.spelt(s) for i, s in zip(ids, symbols, strict=True)))

    def spelt(self, symbol: str) -> Iterable[int]:
        """The ids of a code point that is no piece."""
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else (self.unknown,)

    def merged_words(self, words: Iterable[str], mark: str = "") -> dict[str, tuple[int, ...]]:
        """The ids of words, each with a mark before it."""
        words = list(words)
        ids, ends, number = self.merged_different(pa.array([mark + w for w in words], pa.large_string()))
        return {w: tuple(ids[ends[i] : ends[i + 1]].tolist()) for w, i in zip(words, number.tolist(), strict=True)}

    def merged_different(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of different words, in an order of its own, where each word's end, and the place
        of each word in that order: short words of a length are merged together, if there are enough."""
        import pyarrow.compute as pc  # in workers only: the driver needs none of it

        length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        length = np.where(length > SHORT, 0, length)
        length[np.bincount(length)[length] < TOGETHER if len(length) else []] = 0
        order = np.argsort(length, kind="stable")
        alone = np.count_nonzero(length == 0)
        if len(self.held) > HELD:
            self.older, self.held = self.held, {}
        ids, ends = flat([self.remembered(w) for w in words.take(pa.array(order[:alone])).to_pylist()])
        parts, sizes = [ids], [np.diff(ends)]
        letters = words.take(pa.array(order[alone:])).buffers()[2]
        codes = np.frombuffer((letters.to_pybytes() if letters else b"").decode().encode("utf-32-le"), np.uint32)
        for n, many in zip(*np.unique(length[order[alone:]], return_counts=True), strict=True):
            own, codes = np.split(codes, [n * many])
            for i in range(0, many, AT_ONCE):
                ids, size = self.merged_codes(own.reshape(many, n)[i : i + AT_ONCE])
                parts.append(ids)
                sizes.append(size)
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        return np.concatenate(parts), np.cumsum(np.concatenate([[0], *sizes])), number

    def remembered(self, word: str) -> tuple[int, ...]:
        ids = self.held.get(word) or self.older.get(word) or self.merged(word)
        if len(word) <= LONGEST:
            self.held[word] = ids
        return ids

    def merged_codes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts of one length, each a row of code points, all ids, and how many each has."""
        last = self.pairs.merged(self.pairs.of_code.take(codes.T)).T
        kept = last >= 0
        ids, sizes = self.pairs.ids.take(last[kept]), kept.sum(1)
        # Code points that are no piece are spelt: they are where the texts have them.
        if len(odd := np.flatnonzero(ids < 0)):
            spelt = codes[kept][odd]
            if not self.bytes:
                ids[odd] = self.unknown
                return ids, sizes
            each = np.ones(len(ids), np.int64)
            each[odd] += sum((spelt > most).astype(np.int64) for most in (0x7F, 0x7FF, 0xFFFF))
            sizes = np.add.reduceat(each, np.cumsum(sizes) - sizes)
            ids = np.repeat(ids, each)
            ids[ids < 0] = self.of_byte.take(np.frombuffer(spelt.tobytes().decode("utf-32-le").encode(), np.uint8))
        return ids, sizes

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode_batch(texts).texts()]

    def encode_batch(self, texts: list[str]) -> Batch:
        import pyarrow.compute as pc  # in workers only, as above

        if self.words is None:
            return Batch.of_lists([self.merged(self.prefix + t.replace(" ", MARK)) if t else () for t in texts])
        spaced = [self.spaced(t) for t in texts]
        every = pa.array([" ".join(t for t in spaced if t)] if any(spaced) else [], pa.large_string())
        every = pc.split_pattern(every, " ").flatten().dictionary_encode()
        words = every.dictionary
        if self.prefix:
            words = pc.if_else(pc.match_substring(words, MARK), words, pc.binary_join_element_wise(pa.scalar(MARK, words.type), words, pa.scalar("", words.type)))
        ids, ends, number = self.merged_different(words)
        return Batch(ids, ends, number.take(every.indices.to_numpy()), [t.count(" ") + 1 if t else 0 for t in spaced])

    def agree(self, texts: list[str], ids: list[np.ndarray], decoded: list[str]) -> list[bool]:
        """Of each text, whether the library makes the same ids of it, and the same text of them."""
        theirs = ((self.library.encode(t, return_type="numpy"), i, d) for t, i, d in zip(texts, ids, decoded, strict=True))
        return [np.array_equal(e, i) and d == self.library.decode(e) for e, i, d in theirs]

    def words_of(self, text: str) -> list[str]:
        return self.spaced(text).split(" ") if text else []

    def spaced(self, text: str) -> str:
        """The words of a text, with one space between them. Where texts begin with a mark so do all
        words, and those with no other are named without it: most texts are then as they are."""
        if not text or self.prefix and "  " not in text and MARK not in text and text[0] != " " != text[-1]:
            return text
        words = self.words.findall(self.prefix + text.replace(" ", MARK))
        return " ".join([w[1:] if len(w) > 1 and w.rfind(MARK) == 0 else w for w in words] if self.prefix else words)

    def decode(self, ids: list[int]) -> str:
        """What pieces and bytes say, without the mark that the first piece begins with; each byte
        that is no part of a code point becomes U+FFFD."""
        # A control piece says nothing, but bytes on both sides of it make no code point.
        runs = [ids] if self.silent.isdisjoint(ids) else [list(run) for silent, run in groupby(ids, self.silent.__contains__) if not silent]
        out = "".join(b"".join(map(self.written.__getitem__, run)).decode(errors="each_byte") for run in runs)
        first = next((i for i in ids if self.written[i]), None)
        return out[1:] if self.prefix and first in self.marked else out

    def decode_all(self, texts: list[list[int]]) -> list[str]:
        """`decode` of each text: the bytes of all texts are joined at once."""
        return self.decode_batch(Batch.of_lists(texts))

    def decode_batch(self, batch: Batch) -> list[str]:
        data, ends = batch.joined(self.shown)
        out, silent = [], not self.silent.isdisjoint(np.unique(batch.ids).tolist())
        for ids, begin, end in zip(batch.texts(), ends, ends[1:], strict=False):
            if not len(ids) or silent or not self.written[ids[0]]:
                out.append(self.decode(ids.tolist()))
                continue
            said = data[begin:end].decode(errors="each_byte")
            out.append(said[1:] if self.prefix and ids[0] in self.marked else said)
        return out


def taken(table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """What a table holds for each id, joined, and where what ends of `ends` ends in that."""
    if not len(ids):
        return pa.py_buffer(b""), ends
    _, at, data = table.take(pa.array(ids)).buffers()
    return data or pa.py_buffer(b""), np.frombuffer(at, np.int64, len(ids) + 1)[ends]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    return Vocabulary(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with columns ids, decoded and agrees (named with underscores where taken); `path`
    is a model file that all executors have."""
    names = [free(n, docs.columns) for n in ("ids", "decoded", "agrees")]
    at, every = docs.columns.index(text), [*docs.columns, *names]

    def run(batches):
        v = vocabulary(path)
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ours = v.encode_batch(texts)
            decoded, (ids, ends) = v.decode_batch(ours), ours.numbers()
            agrees = v.agree(texts, ours.texts(), decoded)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            more = [lists, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=every)

    kinds = (T.ArrayType(T.IntegerType()), T.StringType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    return docs.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees: digests are made where the ids are,
    so that neither ids nor texts leave the workers."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        v = vocabulary(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ours = v.encode_batch(texts)
            decoded, each = v.decode_batch(ours), ours.texts()
            data, ends = ours.joined(v.digits)
            # Without the last comma.
            digits = [hashlib.sha256(data[begin : max(begin, end - 1)]).hexdigest() for begin, end in pairwise(ends)]
            columns = [*map(len, each)], digits, [*map(_sha, decoded)], v.agree(texts, each, decoded)
            types = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            made = [pa.array(c, k) for c, k in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean")
