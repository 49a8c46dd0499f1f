"""Token ids of a tokenizer file, in tasks."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, others follow from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str, plain_text: bool = False) -> Callable[[str], np.ndarray] | None:
    """The same ids by tiktoken, where the file is plain byte-level BPE whose ids follow its merges; else None.

    tiktoken gives up (ValueError) on runs of white space of about a million characters; such texts go to tokenizers itself.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    if not plain:
        return None
    letters, special = _byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if sorted(ranks.values()) != list(range(len(ranks))) or any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special=set() if plain_text else "all", disallowed_special=())
        except ValueError:
            return _library(path, plain_text)(text)

    return encode


@lru_cache(maxsize=4)
def _library(path: str, plain_text: bool = False) -> Callable[[str], np.ndarray]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = plain_text
    model.no_truncation()
    model.no_padding()
    return lambda text: np.asarray(model.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=8)
def encoder(path: str, plain_text: bool = False) -> Callable[[str], np.ndarray]:
    """text -> unsigned 32-bit ids, as the tokenizer's own library gives them: no added tokens, no truncation, no padding.

    With ``plain_text`` the strings of special tokens inside a text are ordinary text. A .json file belongs to tokenizers, a .model file to sentencepiece. Plain byte-level BPE files run on an equivalent, faster
    encoder built from the same file; the tests hold both against each other.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: np.asarray(model.encode(text), np.uint32)
    return _ranked(path, plain_text) or _library(path, plain_text)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for: entries of a byte-level .json file decoded, pieces of a .model file in UTF-8 with U+2581 as space
    and byte pieces as their byte. Ids that no text gets (control, unknown, gaps) have none or their own spelling."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        hidden = [model.is_control(i) or model.is_unknown(i) for i in range(len(model))]
        return [b"" if hidden[i] else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(len(model))))]
    from tokenizers import Tokenizer

    letters = _byte_letters()
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for word, i in vocab.items():
        out[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
    return out
