"""Byte-level BPE ids of whole texts, with a memo of the ids of each word."""

from functools import cache

#: Characters of which every Unicode version says the same, as letters, numbers and white space; a stretch of text
#: with any other goes to the library.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я一-龥", "0-9²³¹¼½¾", " \\t\\n\\r\\xa0"
UNSETTLED = rf"[^{LETTERS}{SPACES}\x21-\x7e\xa1-\xbf×÷‐-‧]"
#: How words are split before byte pairs are merged: fixed, the pattern of byte-level vocabularies, said for settled characters.
WORDS = rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: No word spans a space between two such characters, so a long text can be cut there.
CUT = r"(?<=[!-~]) (?=[!-~])"
#: Bytes that a memo may hold, with what Python needs for an entry; characters of the longest word kept.
MEMO_BYTES, ENTRY, LONGEST = 80 << 20, 128, 64
#: What the file of a byte-level vocabulary must say for WORDS to hold; with any other the library does everything.
PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Encoder:
    """ids(text) gives little-endian unsigned 32-bit ids as bytes: those of the library, as the file sets it up, without special tokens added.

    The string of an added token in a text therefore stands for that token.
    Words recur, so their ids are kept, up to `memo_bytes`.  Texts are taken
    in stretches of about `step` characters, cut where no word can be.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES, step: int = 1 << 16):
        import json
        import re

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.library, self.step = Tokenizer.from_file(path), step
        self.added = [x["content"] for x in said["added_tokens"]]
        model, pre = said["model"], {k: v for k, v in (said["pre_tokenizer"] or {}).items() if k != "trim_offsets"}
        odd = [said["normalizer"], said.get("truncation"), said.get("padding"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
        self.plain = pre == PLAIN and model.get("type") == "BPE" and not any(odd)
        self.divisible = self.plain and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in said["added_tokens"])
        self.split, self.unsettled, self.cut = re.compile(WORDS).findall, re.compile(UNSETTLED).search, re.compile(CUT).search
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        space, merge = table[32], self.library.model.tokenize
        packed = self.packed = [k.to_bytes(4, "little") for k in range(self.library.get_vocab_size())]

        class Memo(dict):
            """Words met of late, and of those met before them as many."""

            room, older = memo_bytes // 2, {}  # noqa: RUF012

            def __missing__(self, word):
                if (ids := self.older.get(word)) is None:
                    if word.isascii() and word.isprintable():
                        shown = word.replace(" ", space)
                    else:
                        shown = word.encode("utf-8", "replace").decode("latin-1").translate(table)
                    ids = b"".join([packed[x.id] for x in merge(shown)])
                if len(word) <= LONGEST:
                    self.room -= ENTRY + word.__sizeof__() + len(ids)
                    if self.room < 0:
                        self.older = dict(self)
                        self.clear()
                        self.room = memo_bytes // 2
                    self[word] = ids
                return ids

        self.memo = Memo()

    def stretches(self, text: str):
        """Parts of a text whose ids are those of the text, one after the other."""
        at = 0
        while len(text) - at > self.step and (found := self.cut(text, at + self.step)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        own, out = self.memo.__getitem__, []
        for part in self.stretches(text) if self.divisible else [text]:
            if not self.plain or self.unsettled(part) or any(x in part for x in self.added):
                out.append(b"".join([self.packed[k] for k in self.library.encode(part, add_special_tokens=False).ids]))
            else:
                out += map(own, self.split(part))
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    """The process's own Encoder of that file."""
    return Encoder(path)


def texts(column, step: int = 128):
    """The strings of an Arrow column, a few at a time, so long ones don't all lie in Python's memory."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()
