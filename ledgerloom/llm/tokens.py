"""Byte-level BPE, exactly as the ``tokenizers`` library encodes it.

The file is a ``tokenizers`` JSON file whose vocabulary ranks its merges (token
id order is merge order); it is never copied or trained.  Long texts are encoded
by *tree concatenation*: both halves are encoded on their own, in parallel, and
the text around the join is encoded again in a growing window until the window
and both halves agree, so that the result is the encoding of the whole.

Why agreement is enough
    A window begins where a token of the left half does and ends where one of the
    right half does, and it is taken only if its first token is that token of the
    left half and its last token that of the right half.  The splitting pattern works
    from left to right and looks ahead only behind white space, so that a change from
    a letter or a digit to another class, or from anything else into white space, ends
    a piece wherever the text came from.  A window that begins at such a place is cut
    into pieces as the whole is.  Where a half has none near the join (one run of letters,
    of digits, of signs or of white space, of any length), the window begins inside the
    run: byte pair encoding of a piece is valid exactly if each two adjacent tokens are,
    so a window that shares a token with the half can be spliced in there.  (Not in front
    of an apostrophe, which might begin a piece of its own.)  Failing both, the window
    grows to the half's end, where there is nothing left to agree with.

Defined results
    A null text counts as empty and has no ids.  Strings of added tokens inside
    a text get the added token's id, as the library does by default.  Rows are encoded
    each, repeated ones and those with null keys too; an empty table gives no rows; a
    text of any length is one row, and other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import json
import re

#: Characters of a leaf, and of a first window on either side of a join.
LEAF_CHARS = 4096
WINDOW_CHARS = 32
#: Threads of a worker that encode leaves; the library encodes outside Python's lock.
THREADS = 2

#: Unicode's white space.
SPACE = "\t-\r \x85\xa0  -     　"
#: The vocabulary's splitting pattern without its look-ahead, which ``_safe_parts`` makes needless.
LINEAR_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

_before_last_space = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")
_two_spaces = re.compile(f"[{SPACE}][{SPACE}]")
_is_space = re.compile(f"[{SPACE}]")


def byte_of_symbol() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: themselves where printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word edges are not supported")
        symbols = byte_of_symbol()
        ranks = {bytes(map(symbols.__getitem__, s)): i for s, i in model["vocab"].items() if s not in added}
        merged = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        ids = [model["vocab"][s] for s in merged]
        if ids != sorted(ids):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.added = added
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *added.values()]))
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self._split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=LINEAR_PATTERN, mergeable_ranks=ranks, special_tokens={})

    # -- encoding ---------------------------------------------------------

    def encode(self, text: str | None, leaf_chars: int = LEAF_CHARS) -> list[int]:
        """Ids of the whole text."""
        if not text:
            return []
        if self._split_added is None or not any(t in text for t in self.added):
            return self._tree(text, leaf_chars)
        out: list[int] = []
        for part in self._split_added.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self._tree(part, leaf_chars)
        return out

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens, in one go."""
        if _two_spaces.search(text) is None:
            return self._bpe.encode_ordinary(text)
        out: list[int] = []
        for part in _before_last_space.split(text):
            out += self._bpe.encode_ordinary(part)
        return out

    def _tree(self, text: str, leaf_chars: int) -> list[int]:
        if len(text) <= leaf_chars:
            return self._plain(text)
        texts = _halves(text, leaf_chars)
        ids = list(_pool().map(self._plain, texts))
        while len(texts) > 1:
            pairs = range(0, len(texts) - 1, 2)
            joined = [self._join(texts[i], ids[i], texts[i + 1], ids[i + 1]) for i in pairs]
            odd = [ids[-1]] if len(texts) % 2 else []
            texts = [texts[i] + texts[i + 1] for i in pairs] + ([texts[-1]] if odd else [])
            ids = joined + odd
        return ids[0]

    def _join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right`` from the ids of both."""
        before = after = WINDOW_CHARS
        while True:
            head, tail = self._left_cut(left, left_ids, before), self._right_cut(right, right_ids, after)
            first = last = True
            if head and tail:
                (start, kept), (end, rest) = head, tail
                window = self._plain(left[start:] + right[:end])
                first = start == 0 or window[0] == left_ids[kept]
                last = end == len(right) or window[-1] == right_ids[rest - 1]
                if first and last:
                    return left_ids[:kept] + window + right_ids[rest:]
            # the side that has no place or doesn't agree gets a longer window
            before *= 1 if head and first else 4
            after *= 1 if tail and last else 4

    def _left_cut(self, text: str, ids: list[int], reach: int) -> tuple[int, int] | None:
        """Place in the left half where a window may begin, and ids before it; None if there's none so near."""
        low = len(text) - reach
        if low <= 0:
            return 0, 0
        run = _one_run(text[low - 1 :])
        for i in range(low, len(text)):
            if (text[i] != "'" if run else _firm(text[i - 1], text[i])) and (kept := self._upto(ids, text, i)) is not None:
                return i, kept
        return None

    def _right_cut(self, text: str, ids: list[int], reach: int) -> tuple[int, int] | None:
        """Place in the right half where a window may end, and ids before it; None if there's none so near."""
        if reach >= len(text):
            return len(text), len(ids)
        run = _one_run(text[: reach + 1])
        for i in range(reach, 0, -1):
            if (run or _firm(text[i - 1], text[i])) and (rest := self._before(ids, text, i)) is not None:
                return i, rest
        return None

    def _upto(self, ids: list[int], text: str, at: int) -> int | None:
        """How many of the ids make ``text[:at]``, counted from the end; None if a token lies across."""
        left, k = len(text[at:].encode()), len(ids)
        while left > 0:
            k -= 1
            left -= len(self.bytes_of[ids[k]])
        return k if left == 0 else None

    def _before(self, ids: list[int], text: str, at: int) -> int | None:
        """How many of the ids make ``text[:at]``, counted from the start; None if a token lies across."""
        left, k = len(text[:at].encode()), 0
        while left > 0:
            left -= len(self.bytes_of[ids[k]])
            k += 1
        return k if left == 0 else None

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _halves(text: str, most: int) -> list[str]:
    """The leaves of the tree that halves ``text`` until no part is over ``most`` characters."""
    parts = 1
    while len(text) > most * parts:
        parts *= 2
    edges = [len(text) * k // parts for k in range(parts + 1)]
    return [text[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def _class(c: str) -> str:
    if _is_space.match(c):
        return " "
    kind = _category(c)
    return kind if kind in "LN" else "S"


@functools.lru_cache(1 << 16)
def _category(c: str) -> str:
    import regex

    return "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S"


def _firm(a: str, b: str) -> bool:
    """Whether a piece ends between two characters whatever surrounds them."""
    x, y = _class(a), _class(b)
    return x != y and (x in "LN" or (x == "S" and y == " "))


def _one_run(text: str) -> bool:
    """Whether all characters are of one class: letters, digits, signs or white space."""
    first = _class(text[0])
    return all(_class(c) == first for c in text)


@functools.lru_cache(1)
def _pool():
    from concurrent.futures import ThreadPoolExecutor

    return ThreadPoolExecutor(THREADS)


@functools.lru_cache(4)
def codec(path: str) -> ByteBpe:
    """One codec a worker and file."""
    return ByteBpe(path)


def encode_frame(df, path: str, emit, schema: str, id_column: str = "doc_id", text_column: str = "text"):
    """Apply ``emit(keys, texts, ids)`` to every row's key, text and ids, in small steps.

    Nothing is shuffled: a text is encoded where its row is read.
    """
    from ledgerloom.llm.common import map_steps

    def step(columns):
        keys, texts = columns
        bpe = codec(path)
        return emit(keys, texts, [bpe.encode(t) for t in texts])

    return map_steps(df.select(f"`{id_column}`", f"`{text_column}`"), step, schema)


def encode_documents(df, path: str):
    """``doc_id``, ``ids`` and the text that they decode to, of every row."""
    return encode_frame(
        df, path,
        lambda keys, texts, ids: {"doc_id": keys, "ids": ids, "decoded": [codec(path).decode(i) for i in ids]},
        "doc_id long, ids array<int>, decoded string",
    )


def roundtrip_digests(df, path: str):
    """Digests of what ``encode_documents`` returns, made where it is made, so that no id leaves the worker."""
    import hashlib

    def emit(keys, texts, ids):
        bpe, sha = codec(path), lambda b: hashlib.sha256(b).hexdigest()
        names = _decimals(len(bpe.bytes_of))
        return {
            "doc_id": keys,
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [sha(",".join(map(names.__getitem__, i)).encode()) for i in ids],
            "decoded_sha256": [sha(bpe.decode(i).encode()) for i in ids],
        }

    return encode_frame(df, path, emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@functools.lru_cache(2)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]
