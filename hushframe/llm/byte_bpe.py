"""Operator 1: byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

A token sequence is the encoding of its bytes exactly if every two neighbours are the encoding of theirs, so every prefix has one last token. The
tokens' trie, begun anew at each byte, is a nondeterministic machine for where tokens end; subset construction makes it deterministic,
state by state when first reached. On each byte the transducer takes the one ending token that agrees with the last token before its start.
Tokens that all starts still open share are settled, and no start is open for longer than the longest token. A match is looked at for settled tokens at every
SETTLE bytes, so a token comes out after SETTLE bytes and the longest token at the latest, or when its match ends.

Nulls and empty texts give no tokens. Texts of any length go through in one pass; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import batched, chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hushframe.llm.common import Kept, arrow_map, id_and_text, worker_cache

RANKS = "byte_bpe_50k.tiktoken"
#: States and agreed pairs that are kept; beyond it each table starts anew. Bytes of one match after which settled tokens are emitted.
STATES, PAIRS, SETTLE = 150_000, 1_000_000, 4096
#: What the pattern's \s means there: Unicode White_Space, which leaves out U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0  -     　"


def splitter(pattern: str):
    """findall of the pattern, with \\s and \\S spelt out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall


class Transducer:
    """Token ids of a byte string by the ranks of its merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {r: b for b, r in ranks.items()}
        self.child: list[dict[int, int]] = [{}]  # the trie of all tokens
        self.token, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if (nxt := self.child[node].get(byte)) is None:
                    nxt = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = rank
        self.agreed: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int]] = {}
        self.restart()

    def restart(self) -> None:
        """Forget all states but the first, in which no token is begun."""
        self.states: list[tuple[int, ...]] = [()]  # live trie nodes, longest first
        self.ends: list[tuple[tuple[int, int], ...]] = [()]  # tokens that end here and their bytes
        self.number: dict[tuple[int, ...], int] = {(): 0}
        self.moves: list[dict[int, int]] = [{}]

    def merge(self, piece: bytes, parts_left: int = 1) -> list[int]:
        """Merges by their definition, for the bytes of one token; ends at so many parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > parts_left:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one."""
        if (known := self.made.get(token)) is None:
            known = self.made[token] = tuple(self.merge(self.bytes_of[token], 2))
        return known

    def agree(self, left: int, right: int) -> bool:
        """Undo merges of both, the latest first; they agree unless a merge over the border would have come before one undone."""
        before, of = 1 << 60, self.bytes_of
        while True:
            over = self.ranks.get(of[left] + of[right])
            if over is not None and over < before:
                return False
            if left > right:
                if len(of[left]) == 1:
                    return True
                before, left = left, self.halves(left)[1]
            else:
                if len(of[right]) == 1:
                    return True
                before, right = right + 1, self.halves(right)[0]

    def neighbours(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) >= PAIRS:
                self.agreed.clear()
            known = self.agreed[key] = self.agree(left, right)
        return known

    def number_of(self, live: tuple[int, ...]) -> int:
        if (known := self.number.get(live)) is None:
            known = self.number[live] = len(self.states)
            self.states.append(live)
            self.ends.append(tuple((t, len(self.bytes_of[t])) for t in map(self.token.__getitem__, live) if t >= 0))
            self.moves.append({})
        return known

    def move(self, state: int, byte: int) -> int:
        """Make a transition that wasn't taken before."""
        live = self.states[state]
        if len(self.states) > STATES:  # go on from the live nodes alone
            self.restart()
            state = self.number_of(live)
        to = self.number_of(tuple(n for n in (self.child[m].get(byte, 0) for m in (*live, 0)) if n))
        self.moves[state][byte] = to
        return to

    def settled(self, last: list[int], starts: list[int]) -> int:
        """The latest token border that the encodings up to all these positions share."""
        borders: set[int] | None = None
        for at in starts:
            chain_, k = {at}, at
            while k > 0:
                k -= len(self.bytes_of[last[k]])
                chain_.add(k)
            borders = chain_ if borders is None else borders & chain_
        return max(borders)

    def back(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Tokens as soon as they are settled, some at a time."""
        last, state, agreed = [-1], 0, self.agreed
        for byte in data:
            to = self.moves[state].get(byte)
            state = self.move(state, byte) if to is None else to
            at = len(last)
            for token, size in self.ends[state]:
                left = last[at - size] if size <= at else -2
                if left < 0:
                    if left == -1 and size == at:
                        break
                    continue
                known = agreed.get(left << 20 | token)
                if self.neighbours(left, token) if known is None else known:
                    break
            else:
                raise ValueError("no token ends here")
            last.append(token)
            if at % SETTLE == 0 and (border := self.settled(last, [at, *(at - self.depth[n] for n in self.states[state])])):
                yield self.back(last, border)
                last = last[border:]
        yield self.back(last, len(last) - 1)

    def encode(self, data: bytes) -> list[int]:
        return [token for some in self.stream(data) for token in some] if data else []


class Utf8Stream:
    """An incremental UTF-8 machine: its state is the bytes of a code point begun but not complete."""

    def __init__(self):
        self.begun = b""

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        end = len(data)
        for back in range(1, min(4, end) + 1):  # look for a lead byte whose code point isn't complete
            byte = data[end - back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                need = 2 + (byte >= 0xE0) + (byte >= 0xF0)
                end -= back if back < need else 0
                break
        self.begun = data[end:]
        return data[:end].decode("utf-8", "strict")

    def close(self) -> str:
        begun, self.begun = self.begun, b""
        return begun.decode("utf-8", "replace")


class SideBySide(Exception):
    """White space beside white space: the text has to be split as a whole."""


def edge(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace()


class ByteBpe:
    """Encodes texts match by match, decodes ids as a stream."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fst, self.split = Transducer(ranks), splitter(pattern)
        self.bytes_of = [self.fst.bytes_of.get(i, b"") for i in range(max(self.fst.bytes_of) + 1)]
        self.written = [str(i) for i in range(len(self.bytes_of))]
        self.pieces, self.words = Kept(self.piece), Kept(self.word)

    def piece(self, text: str) -> tuple[int, ...]:
        return tuple(self.fst.encode(text.encode()))

    def matches(self, text: str) -> tuple[int, ...]:
        """The definition: the pattern's matches, each through the transducer."""
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of what stands between two spaces, with the space before it. No match crosses the border before a lone space or line break."""
        if edge(text[text[:1] == "\n" :]):
            raise SideBySide(text)
        return self.matches("\n") + self.matches(text[1:]) if text[0] == "\n" else self.matches(" " + text)

    def encode(self, text: str) -> list[int]:
        first, *words = text.replace("\n", " \n").split(" ")
        try:
            if edge(first):
                raise SideBySide(first)
            ids = list(self.matches(first))
            ids.extend(chain.from_iterable(map(self.words.__getitem__, words)))
            return ids
        except SideBySide:
            return list(self.matches(text))

    def decode(self, ids: Iterable[int], block: int = 65536) -> Iterator[str]:
        """Text as soon as its code points are complete; holds one block of ids at most."""
        machine = Utf8Stream()
        for some in batched(ids, block):
            yield machine.feed(b"".join(map(self.bytes_of.__getitem__, some)))
        yield machine.close()


@worker_cache(2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    path = path or public_tokenizers.path(RANKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = codec(path, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([of.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(id_and_text(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids count as none."""
    path = path or public_tokenizers.path(RANKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = codec(path, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(of.decode(i or ())) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode every document in one pass; the ids stay in the worker, their digests come out."""
    path = path or public_tokenizers.path(RANKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, counts, coded, decoded = codec(path, pattern), [], [], []
        for text in batch.column(1).to_pylist():
            ids = of.encode(text)
            counts.append(len(ids))
            coded.append(hashlib.sha256(" ".join(map(of.written.__getitem__, ids)).encode()).hexdigest())
            digest = hashlib.sha256()
            for part in of.decode(ids):
                digest.update(part.encode())
            decoded.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(id_and_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
