"""Token ids by the tokenizers library, with a bounded memory of the pieces that words have given.

A text is cut only where the tokenizer's own first split always cuts, each distinct part is encoded by the
library once, and the ids of the parts are joined. The result equals that of encoding the whole text. Texts
that may hold the string of a special token are given to the library whole.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import kept_in_worker

#: A space or line end before more white space; without one, every space and line end starts a part.
_RUN = re.compile(r"[ \n]\s")
_SPACE = re.compile(r" (?=\S)")
#: Marks that may be cut from the letters before them; an apostrophe may belong with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Strings of special tokens begin so.
_SPECIAL = "<|"


def located(tokenizer: str) -> str:
    """A path, or the name of one of the public tokenizers, which is looked up where it is used."""
    if os.path.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def only_letters(text: str) -> bool:
    """Whether the text is letters alone, and stays so when it is normalised and put in lower case."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


def whole(text: str) -> bool:
    """Whether the text, not empty, is free of white space."""
    return len(text.split()) == 1 and not text[0].isspace() and not text[-1].isspace()


class Encoder:
    """kind "byte": byte-level BPE that keeps white space, a single space going with the word after it.
    kind "word": BPE with word ends that drops white space. Ids are those of the library as it stands; with
    ``special_as_text`` strings of special tokens are ordinary text. ``most`` bounds the parts that are kept: when so
    many are new, those not met since the last time go."""

    def __init__(self, tokenizer: str, kind: str, most: int = 200_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(located(tokenizer))
        self.library.encode_special_tokens = special_as_text
        self.kind, self.most = kind, most
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.parts: dict[str, bytes] = {}  # of parts after a space, or that begin with a line end
        self.older: dict[str, bytes] = {}  # of those before the last bound, until they are met again
        self.marks: dict[str, bytes] = {}  # of marks without a space
        # tokens that hold a space, or a line end, at their start, or the end of a word
        self.space, self.line, self.last = (np.zeros(max(vocab.values(), default=0) + 1, bool) for _ in range(3))
        for t, i in vocab.items():
            self.space[i], self.line[i], self.last[i] = t[:1] == "Ġ", t[:1] == "Ċ", t[-4:] == "</w>"

    def _singly(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, parts: list[str], lead: str, bound: np.ndarray, rest: list[str]) -> None:
        """Ids of parts that are encoded as one text and told apart by tokens that only begin (or end) a part. What
        the tokenizer cuts into another number of parts goes to the rest."""
        runs = [parts[i : i + 256] for i in range(0, len(parts), 256)]
        for run, e in zip(runs, self.library.encode_batch_fast([lead + lead.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(bound[ids])
            if len(at) != len(run):
                rest += run
                continue
            at = (at * ids.itemsize).tolist()
            cuts, data = [*at, ids.nbytes] if self.kind == "byte" else [0, *(x + ids.itemsize for x in at)], ids.tobytes()
            self.parts.update(zip(run, [data[a:z] for a, z in zip(cuts, cuts[1:])], strict=True))

    def _learn(self, new: list[str]) -> None:
        """Put parts that aren't known among those that are."""
        known, older, words, lines, rest = self.parts, self.older, {}, {}, {}
        forms: list[tuple[str, str, str]] = []
        for p in new:
            core, marks = p, ""
            if not p.isalpha():
                # letters and the marks after them never share a token
                core = p.rstrip(_MARKS)
                if only_letters(core[1:] if core[:1] == "\n" else core):
                    if len(core) < len(p):
                        marks = p[len(core) :]
                        forms.append((p, core, marks))
                        if core in known:
                            continue
                        if core in older:
                            known[core] = older[core]
                            continue
                else:
                    core = p
            if self.kind == "word":
                (words if only_letters(core) else rest)[core] = None
            elif core[:1] == "\n":
                (lines if whole(core[1:]) else rest)[core] = None
            else:
                (words if core.isalpha() or whole(core) else rest)[core] = None
        alone = list(rest)
        if self.kind == "word":
            self._together(list(words), " ", self.last, alone)
        else:
            self._together(list(words), " ", self.space, alone)
            self._together(list(lines), "", self.line, alone)
        known.update(zip(alone, self._singly([p if self.kind == "word" or p[:1] == "\n" else " " + p for p in alone]), strict=True))
        if len(self.marks) > self.most:
            self.marks.clear()
        marks = [m for m in dict.fromkeys(f[2] for f in forms) if m not in self.marks]
        self.marks.update(zip(marks, self._singly(marks), strict=True))
        for p, core, m in forms:
            known[p] = known[core] + self.marks[m]

    def _known(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct parts."""
        if len(self.parts) > self.most:
            self.older, self.parts = self.parts, {}
        out = list(map(self.parts.get, distinct))
        new = [k for k, ids in enumerate(out) if ids is None]
        before = list(map(self.older.get, [distinct[k] for k in new]))
        self.parts.update((distinct[k], ids) for k, ids in zip(new, before) if ids is not None)
        self._learn([distinct[k] for k, ids in zip(new, before) if ids is None])
        for k in new:
            out[k] = self.parts[distinct[k]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of the size of self.dtype."""
        gc.disable()  # many short-lived lists and no cycles: collections would only walk them
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        special = [i for i, t in enumerate(texts) if _SPECIAL in t]
        if special:
            of = dict(zip(special, self._singly([texts[i] for i in special]), strict=True))
            plain = iter(self._encode([t for t in texts if _SPECIAL not in t]))
            return [of[i] if i in of else next(plain) for i in range(len(texts))]
        if self.kind == "word":
            return self._joined(_split(texts, " "))
        runs = [i for i, t in enumerate(texts) if _RUN.search(t)]
        if not runs:
            return self._joined(_split(texts, " \n"))
        of = dict(zip(runs, self._joined(pa.array([_SPACE.split(texts[i]) for i in runs], pa.large_list(pa.large_string()))), strict=True))
        left = [t for i, t in enumerate(texts) if i not in of]
        plain = iter(self._joined(_split(left, " \n")))
        return [of[i] if i in of else next(plain) for i in range(len(texts))]

    def _joined(self, cut: pa.LargeListArray) -> list[bytes]:
        """Ids of texts that are cut into parts; that before the first space, if spaces are kept, has none."""
        if not len(cut):
            return []
        at, values = cut.offsets.to_numpy(), cut.values
        if self.kind == "byte":
            first = at[:-1]
            heads = values.take(pa.array(first)).to_pylist()
            of_heads = self._singly(heads)
            values = values.filter(pa.array(np.bincount(first, minlength=len(values)) == 0))
            at = at - np.arange(len(at))
        else:
            of_heads = [b""] * len(cut)
        coded = values.dictionary_encode()
        ids = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts, data, codes = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), self.dtype), coded.indices.to_numpy()
        out, ends = [], np.concatenate([[0], np.cumsum(sizes[codes])])
        for i in range(0, len(codes), 1 << 19):  # a range of parts at a time, which bounds what is held of a long text
            some = codes[i : i + (1 << 19)]
            each, to = sizes[some], ends[i : i + len(some)] - ends[i]
            out.append(data[np.repeat(starts[some] - to, each) + np.arange(to[-1] + each[-1])].tobytes())
        joined, bounds = b"".join(out), (ends[at] * self.dtype.itemsize).tolist()
        return [h + joined[a:z] for h, a, z in zip(of_heads, bounds[:-1], bounds[1:], strict=True)]


def _split(texts: list[str], line: str) -> pa.LargeListArray:
    """Texts cut at each space; line ends are replaced before."""
    return pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", line), " ").cast(pa.large_list(pa.large_string()))


def encoder(tokenizer: str, kind: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    return kept_in_worker(("encoder", tokenizer, kind), lambda: Encoder(tokenizer, kind))
