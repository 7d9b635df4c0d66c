"""Public tokenizers inside tasks; every task loads its own from the file's path."""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def place(name: str) -> str:
    """A tokenizer file's path: given in full, or the name of a public one."""
    return name if os.path.sep in name else public_tokenizers.path(name)


class WordEncoder:
    """Ids of a text by a tokenizer that never joins characters across white space.

    ``word_bpe_49k.json`` is one: its words are encoded apart and their ids, packed as
    little-endian 32-bit numbers, are remembered. The memory holds ``limit`` short words at
    most; long runs without white space are encoded each time. As the tokenizer lowers
    case, ASCII letters are lowered beforehand, except beside marks that they may compose
    with.
    """

    def __init__(self, name: str = WORD_BPE, limit: int = 600_000):
        # Spark runs a task on each core; more threads in each would only contend.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(place(name))
        self.known: dict[str, bytes] = {}
        self.limit = limit
        self.plain = _PLAIN if place(name) == place(WORD_BPE) else _NEVER

    def _pack(self, words: list[str]) -> list[bytes]:
        """Ids of words. Plain ones, Latin letters and then punctuation, skip the
        tokenizer's normalising and splitting, which change nothing else in them."""
        out: list[bytes | None] = [None] * len(words)
        rest = []
        bpe = self.tokenizer.model.tokenize
        for i, w in enumerate(words):
            if m := self.plain.fullmatch(w):
                ids = [t.id for part in m.groups() if part for t in bpe(part.lower().translate(_AS_BYTES))]
                out[i] = array("I", ids).tobytes()
            else:
                rest.append(i)
        coded = self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, coded, strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def __call__(self, text: bytes) -> bytes:
        if b"\xcc" not in text and b"\xcd" not in text:  # no mark of U+0300 .. U+037F
            text = text.lower()
        words = text.translate(_SPACES).decode().split(" ")
        known = self.known
        if len(known) > self.limit:
            known.clear()
        step = 1 << 16  # bounds what a very long text has in work at once
        return b"".join(self._part(words[i : i + step]) for i in range(0, len(words), step))

    def _part(self, words: list[str]) -> bytes:
        known = self.known
        new = list({w for w in words if w not in known})
        fresh = dict(zip(new, self._pack(new), strict=True)) if new else {}
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
        return b"".join([known[w] if w in known else fresh[w] for w in words])


#: Latin letters that are composed as they are, then punctuation but for ' and <.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+)([!-&(-/:;=-@\[-`{-~]*)")
_NEVER = re.compile(r"(?!)")
#: The letters' UTF-8 bytes as the byte-level alphabet shows them.
_SHOWN = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)}
_SHOWN |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if _SHOWN[b] is None)}
_AS_BYTES = {c: "".join(_SHOWN[b] for b in chr(c).encode()) for c in range(128, 0x180)}
#: Line ends and tabs are white space to the tokenizer as well; others are left to it.
_SPACES = bytes.maketrans(b"\t\n\r", b"   ")
_SHARED: dict[str, WordEncoder] = {}


def word_encoder(name: str = WORD_BPE) -> WordEncoder:
    """The encoder of this Python worker; its memory serves the worker's next tasks too."""
    if name not in _SHARED:
        _SHARED[name] = WordEncoder(name)
    return _SHARED[name]


#: White space runs from here on are cut out before the tokenizer's pattern sees them: it
#: steps back through a run, which at a million marks overflows its stack.
LONG_RUN = 1 << 16
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def rank_count(encoding: tiktoken.Encoding, text: str) -> int:
    """Number of tokens of a text.

    The pattern takes a run of white space as one piece: whole at the end of a text, else
    all but its last mark, which goes on with what follows.
    """
    n = at = 0
    for m in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(encoding.encode_ordinary(text[at : m.start()]))
        n += len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def rank_encoding(name: str = BYTE_BPE) -> tiktoken.Encoding:
    """A byte-level BPE from a file of ranks; strings of special tokens are plain text."""
    with open(place(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
