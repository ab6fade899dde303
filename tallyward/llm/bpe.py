"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 state machine.

A sequence of tokens is the encoding of a string exactly if each adjacent pair of tokens is stable: encoding the two
tokens' bytes together gives back the two tokens. This makes the merges a nondeterministic transducer: read a byte, and
either go on within the current token or close it, which is allowed if the pair with the token before is stable. Its
subset construction is done state by state as texts ask for it. A state holds the open guesses, each with the tokens it
has not emitted yet; the part all guesses share is emitted at once. A guess dies when no token starts with its open bytes,
so at most as many bytes are looked ahead as the longest token has, whatever the length of the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents, resident, slices, text_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A vocabulary travels to every task; files above this are refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Automaton states and remembered pieces kept by a Python worker before it starts anew. They bound memory, not results.
MAX_STATES = 400_000
MAX_PIECES = 220_000
MAX_PIECE = 64


def load_ranks(path: str) -> bytes:
    """The bytes of a rank file: a line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Rank by token."""
    pairs = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Merges:
    """Which tokens the merges can form, and which pairs of tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        # Each prefix of a token, by itself: guesses share one object for equal bytes.
        self.prefixes = {p: p for token in ranks for p in (token[:n] for n in range(1, len(token) + 1))}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge forms a token; None for one that the merges before it do not leave as two."""
        if token not in self._halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            limit = self.ranks[token]
            while len(parts) > 2:
                ranked = [self.ranks.get(a + b, limit) for a, b in zip(parts, parts[1:])]
                at = min(range(len(ranked)), key=ranked.__getitem__)
                if ranked[at] >= limit:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def formed(self, token: bytes) -> bool:
        """Whether merging its bytes ends in the token itself."""
        return token in self.ranks and (len(token) == 1 or self.halves(token) is not None)

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay two tokens when their bytes are encoded together.

        Merges are undone from the last to the first. Before each of them, the two pieces that meet at the border must
        not have had a merge of their own that came earlier; of equal merges the left one comes first.
        """
        ranks, far = self.ranks, len(self.ranks) + (1 << 40)
        if left + right in ranks:
            return False
        while len(left) > 1 or len(right) > 1:
            rank_left = ranks[left] if len(left) > 1 else -1
            rank_right = ranks[right] if len(right) > 1 else -1
            if rank_left > rank_right:
                left = self.halves(left)[1]
                if ranks.get(left + right, far) < rank_left:
                    return False
            else:
                right = self.halves(right)[0]
                if ranks.get(left + right, far) <= rank_right:
                    return False
        return True


class Transducer:
    """The subset construction, made as far as texts need it.

    A guess is (ids held back, last token, open bytes), a state a tuple of guesses. `moves` leads from a state's number, times
    256, plus a byte to the next state's number, times 256, plus 1 if ids are emitted on the way; these are in `emits`.
    """

    def __init__(self, merges: Merges, max_states: int = MAX_STATES) -> None:
        self.merges, self.max_states = merges, max_states
        self._reset()

    def _reset(self, *kept: tuple) -> None:
        self.guesses: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: dict[int, int] = {}
        self.emits: dict[int, tuple[int, ...]] = {}
        self.shared: dict[tuple[int, ...], tuple[int, ...]] = {}
        for state in ((((), b"", b""),), *kept):
            self._number(state)

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.guesses) << 8)
        if number == len(self.guesses) << 8:
            self.guesses.append(state)
        return number

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state's number and the ids emitted, worked out and remembered unless the tables start anew."""
        merges, found = self.merges, []
        prefixes, ranks, end = merges.prefixes, merges.ranks, bytes((byte,))
        for waiting, last, opened in self.guesses[state >> 8]:
            opened = prefixes.get(opened + end)
            if opened is not None:
                found.append((waiting, last, opened))
                if opened in ranks and merges.formed(opened) and (not last or merges.stable(last, opened)):
                    found.append(((*waiting, ranks[opened]), opened, b""))
        first, shared = found[0][0], 0
        if first:
            while shared < len(first) and all(len(w) > shared and w[shared] == first[shared] for w, _, _ in found):
                shared += 1
            if shared:
                found = [(waiting[shared:], last, opened) for waiting, last, opened in found]
        if len(self.guesses) >= self.max_states:  # start anew from here
            self._reset(tuple(found))
            return self._number(tuple(found)), first[:shared]
        move, emitted = self._number(tuple(found)), first[:shared]
        if emitted:
            self.moves[state + byte] = move + 1
            self.emits[state + byte] = self.shared.setdefault(emitted, emitted)
        else:
            self.moves[state + byte] = move
        return move, emitted

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        state, out, moves, emits = 0, [], self.moves, self.emits
        for byte in piece:
            move = moves.get(state + byte)
            if move is None:
                state, emitted = self._move(state, byte)
                out += emitted
                moves, emits = self.moves, self.emits
            elif move & 1:
                out += emits[state + byte]
                state = move - 1
            else:
                state = move
        for waiting, _, opened in self.guesses[state >> 8]:
            if not opened:
                out += waiting
        return out


class Encoder:
    """Texts to ids: pieces by the pattern, each through the transducer, with pieces met lately remembered.

    Remembered pieces have two generations: when the young one is full it becomes the old one, from where a piece that is
    met again comes back, so that frequent pieces stay.
    """

    def __init__(self, data: bytes, pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> None:
        self.ranks = parse_ranks(data)
        self.transducer = Transducer(Merges(self.ranks), max_states)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.max_pieces = max_pieces

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece that is not among the young ones; a piece that is a token itself is that token."""
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            rank = self.ranks.get(data)
            ids = tuple(self.transducer.encode(data)) if rank is None else (rank,)
        if len(self.known) >= self.max_pieces:
            self.old, self.known = self.known, {}
        if len(piece) <= MAX_PIECE:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        known, piece = self.known, self.piece
        return list(chain.from_iterable([known.get(p) or piece(p) for p in self.split(text)]))


class Decoder:
    """Ids to text: a state machine whose state is the start of a character that is not complete yet.

    The step of an id in a state is worked out once: the text that becomes complete, and the bytes left over. What can not
    begin or go on a character becomes U+FFFD, as in the standard decoder.
    """

    def __init__(self, data: bytes) -> None:
        self.tokens = {rank: token for token, rank in parse_ranks(data).items()}
        self.steps: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}

    @staticmethod
    def advance(pending: bytes, data: bytes) -> tuple[str, bytes]:
        """The text complete after some bytes, and the bytes of the character still open."""
        data = pending + data
        for n in range(1, min(3, len(data)) + 1):  # an open character has at most three bytes
            lead = data[-n]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                try:
                    data[-n:].decode()
                except UnicodeDecodeError as error:
                    if n < need and error.reason == "unexpected end of data":
                        return data[:-n].decode(errors="replace"), data[-n:]
                break
            if lead < 0x80:
                break
        return data.decode(errors="replace"), b""

    def pieces(self, ids: list[int]) -> Iterator[str]:
        """The text of each id in turn, as far as it is complete."""
        pending, steps = b"", self.steps
        table = steps[pending]
        for i in ids:
            step = table.get(i)
            if step is None:
                step = table[i] = self.advance(pending, self.tokens[i])
            yield step[0]
            if step[1] != pending:
                pending = step[1]
                table = steps.setdefault(pending, {})
        if pending:
            yield pending.decode(errors="replace")


def _encoder(data: bytes, pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> Encoder:
    return resident(("bpe", data, pattern), f"encoder-{max_pieces}-{max_states}", lambda: Encoder(data, pattern, max_pieces, max_states))


def _decoder(data: bytes, pattern: str = public_tokenizers.PATTERN) -> Decoder:
    return resident(("bpe", data, pattern), "decoder", lambda: Decoder(data))


def encode(frame: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """The id column and `ids`, the whole text's token ids without special tokens, as the reference library gives them.

    A null or empty text has no ids. Ids of rows are passed through, repeated or null ones too. Other columns are ignored.
    """
    data = frame.sparkSession.sparkContext.broadcast(load_ranks(path or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(data.value, pattern)
        for batch in slices(batches, 256, 1):
            lists = [np.array(coder.encode(t.decode(errors="replace")), "int32") for t in text_bytes(batch.column(1))]
            ends = np.cumsum([0, *map(len, lists)], dtype="int32")
            flat = np.concatenate([np.zeros(0, "int32"), *lists])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    source = documents(frame, id_column, text_column)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(frame: DataFrame, path: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The id column, `ids` and `text`, the text of the ids. Null or empty ids give the empty text."""
    data = frame.sparkSession.sparkContext.broadcast(load_ranks(path or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _decoder(data.value)
        for batch in slices(batches):
            column = batch.column(1)
            ends = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            texts = ["".join(coder.pieces(flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]
            yield pa.record_batch([batch.column(0), column, pa.array(texts, pa.string())], ["id", "ids", "text"])

    source = documents(frame, id_column, ids_column).withColumn(ids_column, F.coalesce(ids_column, F.array().cast("array<int>")))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_column)


def round_trip(frame: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_column: str = "doc_id",
               text_column: str = "text", max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> DataFrame:
    """Per document the number of ids, the digest of the ids as decimal text, and the digest of what they decode to.

    Encodes and decodes as `encode` and `decode` do, in one pass, so that the ids of a corpus are not moved about for a digest.
    A null or empty text has no ids; repeated rows and null ids are kept as they are; an empty table gives an empty result.
    `max_pieces` and `max_states` bound the memory of a worker; results do not depend on them.
    """
    data = frame.sparkSession.sparkContext.broadcast(load_ranks(path or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, decoder = _encoder(data.value, pattern, max_pieces, max_states), _decoder(data.value, pattern)
        names = [str(i) for i in range(max(decoder.tokens) + 1)]
        for batch in slices(batches, 256, 1):
            counts, digests, back = [], [], []
            for text in text_bytes(batch.column(1)):
                ids = coder.encode(text.decode(errors="replace"))
                counts.append(len(ids))
                digests.append(sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                back.append(sha256("".join(decoder.pieces(ids)).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            yield pa.record_batch(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = documents(frame, id_column, text_column)
    shape = f"id {source.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, shape).withColumnRenamed("id", id_column)
