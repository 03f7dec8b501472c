"""The public byte-level BPE: word splitting, encoding, id-to-piece table.

Files are read where the package `public_tokenizers` is installed (every
worker has it); the path is a parameter and nothing is copied."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

DEFAULT_FILE = "byte_bpe_50k.json"
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@functools.lru_cache(maxsize=4)
def load_ranks(path: str, ranks_path: str):
    """The same vocabulary in the faster tiktoken library (plain text only;
    special tokens are cut out before)."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    are numbered from U+0100 in byte order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def id_to_piece(path: str) -> dict[int, bytes]:
    """Bytes of every id (special tokens: their own text)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_of_symbol()
    pieces = {i: bytes(alphabet[c] for c in s) for s, i in spec["model"]["vocab"].items() if all(c in alphabet for c in s)}
    pieces.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})
    return pieces


def _char_class(category: str) -> str:
    """Character class of a general category within the basic plane (on which
    Python's matcher is fast)."""
    out, start = [], None
    for cp in range(0x10001):
        inside = cp < 0x10000 and unicodedata.category(chr(cp)).startswith(category)
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(cp - 1)) if cp - 1 > start else ""))
            start = None
    return "".join(out)


#: Unicode White_Space (fixed values).
_SPACE = "\t-\r \x85\xa0  -     　"


@functools.lru_cache(maxsize=1)
def _word_pattern() -> re.Pattern:
    letter, number = _char_class("L"), _char_class("N")
    # fixed values: the published pattern of this vocabulary, with the classes spelled out
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+"
                      rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@functools.lru_cache(maxsize=1)
def _odd_pattern() -> re.Pattern:
    """Code points beyond the basic plane, or that this Python's Unicode
    tables do not know: the tokenizer's own splitter takes such texts."""
    return re.compile(f"[\U00010000-\U0010ffff{_char_class('Cn')}]")


def _is_odd(text: str) -> bool:
    return not text.isascii() and _odd_pattern().search(text) is not None


def _plain_words(text: str, path: str) -> list[str]:
    if _is_odd(text):
        return [text[a:b] for _, (a, b) in load_tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
    return _word_pattern().findall(text)


@functools.lru_cache(maxsize=4)
def special_pattern(path: str) -> re.Pattern | None:
    names = sorted(special_tokens(path), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def split_words(text: str, path: str) -> list[str]:
    """Words in order; their concatenation is the text.  Special tokens are
    words of their own."""
    special = special_pattern(path)
    if special is None or special.search(text) is None:
        return _plain_words(text, path)
    out: list[str] = []
    for i, part in enumerate(special.split(text)):
        if i % 2:
            out.append(part)
        elif part:
            out.extend(_plain_words(part, path))
    return out


def encode_text(text: str, path: str, ranks_path: str) -> list[int]:
    """Ids of a whole text (special tokens recognised, none added)."""
    if _is_odd(text):
        return load_tokenizer(path).encode(text, add_special_tokens=False).ids
    enc = load_ranks(path, ranks_path)
    special = special_pattern(path)
    if special is None or special.search(text) is None:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    names = special_tokens(path)
    for i, part in enumerate(special.split(text)):
        if i % 2:
            ids.append(names[part])
        elif part:
            ids.extend(enc.encode_ordinary(part))
    return ids
