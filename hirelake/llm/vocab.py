"""Public tokenizer files read on the driver, used inside tasks: models by their bytes and where texts may be cut.

A model file is a few megabytes, so its bytes travel with the task's function; executors need no path of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer, pre_tokenizers

#: What sentencepiece writes for a space.
SPACE = "▁"
_BPE, _NORMAL, _USER, _UNUSED = 2, 1, 4, 5


def public_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps file ``name``."""
    import public_tokenizers
    return public_tokenizers.path(name)


def model_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


@lru_cache(maxsize=4)
def sentencepieces(model: bytes, prefix: bool = True) -> sentencepiece.SentencePieceProcessor:
    """The processor of a ``.model`` file; without ``prefix`` it adds no space before a text."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    if not prefix:
        proto.normalizer_spec.add_dummy_prefix = False
    out = sentencepiece.SentencePieceProcessor()
    out.LoadFromSerializedProto(proto)
    return out


@lru_cache(maxsize=4)
def byte_bpe(model: bytes, special_as_text: bool = False) -> Tokenizer:
    """The tokenizer of a ``.json`` file, without truncation and padding."""
    out = Tokenizer.from_buffer(model)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = special_as_text
    return out


@lru_cache(maxsize=4)
def cuts_at_spaces(model: bytes) -> bool:
    """Whether merges of this sentencepiece model never cross the place before a run of spaces or either side
    of a line break: a merge makes a piece of the vocabulary, so it is enough that no piece holds such a place.
    Only for BPE models whose normaliser leaves texts as they are."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != _BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        return False
    merged = [p.piece for p in proto.pieces if p.type in (_NORMAL, _USER, _UNUSED) and len(p.piece) > 1]
    return not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in merged)


def piece_counter(path_suffix: str, model: bytes) -> tuple[Callable[[str], list[str]], Callable[[list[str]], list[int]]]:
    """``(cut, count)``: ``cut(text)`` gives the text's pre-tokens, ``count`` the number of tokens of each of them;
    a text's count is the sum over its pre-tokens. Where a model's cuts are not known to be exact, the whole text
    is its only pre-token."""
    if path_suffix == ".model":
        if not cuts_at_spaces(model):
            whole = sentencepieces(model)
            return (lambda text: [text] if text else []), (lambda pres: [len(x) for x in whole.encode(pres, num_threads=1)])
        bare = sentencepieces(model, prefix=False)
        # spaces with the word they stand before; a line break; spaces before a line break or the end
        find = re.compile(f"[ {SPACE}]*[^ {SPACE}\\n]+|\\n|[ {SPACE}]+").findall
        return (lambda text: find(" " + text) if text else []), (lambda pres: [len(x) for x in bare.encode(pres, num_threads=1)])
    if path_suffix == ".json":
        tok = byte_bpe(model)

        def count(pres: list[str]) -> list[int]:
            return [len(e.ids) for e in tok.encode_batch_fast(pres, add_special_tokens=False)]

        level, added = tok.pre_tokenizer, [t.content for t in tok.get_added_tokens_decoder().values()]
        plain = not any(t.lstrip or t.rstrip or t.single_word for t in tok.get_added_tokens_decoder().values())
        if tok.normalizer is not None or not isinstance(level, pre_tokenizers.ByteLevel) or level.add_prefix_space or not plain:
            return (lambda text: [text] if text else []), count
        split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else (lambda t: [t])

        def cut(text: str) -> list[str]:
            out = []
            for k, part in enumerate(split(text)):
                out += [part] if k % 2 else [part[a:b] for _, (a, b) in level.pre_tokenize_str(part)]
            return out
        return cut, count
    raise ValueError(f"not a .json or .model tokenizer: {path_suffix}")
