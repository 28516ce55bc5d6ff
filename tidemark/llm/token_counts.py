"""Token counts by a map-side two-tier lookup.

Byte-level BPE never merges across pre-tokens, so a text's token count is the sum
of the lengths of its pre-tokens. Tier one is a compact hash table, broadcast once,
of the pre-tokens that the vocabulary itself lists as frequent: every entry that is
one pre-token, with the number of tokens the library gives it. Its size is bounded
by the vocabulary, not by the corpus. Tier two is a cache in each Python worker:
a pre-token that tier one misses is encoded by the library once and then kept, up
to ``cache_entries`` of at most ``KEPT_CHARACTERS`` characters each; a full cache starts
anew. No pre-token is ever shuffled.

Texts of all scripts take this way. How a character outside the Latin blocks splits is
asked of the library's own pre-tokenizer, once a worker and character (letter, number,
white space or other); for splitting, it is replaced by a Latin character of its kind.
The special strings of the tokenizer are cut out first and count one token each, as the
library does by default. A tokenizer whose pre-tokenizer is not the byte-level one, or
whose special strings take neighbours with them, encodes whole texts.

Nulls and empty texts have 0 tokens; very long texts are split by an iterator; repeated
rows are counted alike; an empty table gives no rows; extra columns pass, but columns
named ``n_bytes``, ``n_tokens`` or ``over_limit`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Letters, numbers and white space among the characters of Latin-script texts. On these the
#: pattern below splits as the public byte-level one (`'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|
#: ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`) does; others are replaced by one of their kind.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r "
PRETOKEN = rf" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
OTHER = r"[^\t-\r -~¡-ɏ‐-‧‰-⁞€]"
#: Texts of more characters are matched by an iterator, not a list.
LONG = 1 << 20
#: Longer pre-tokens are encoded whenever they occur.
KEPT_CHARACTERS = 64
#: What a character of each kind is replaced by.
LIKE_LETTER, LIKE_NUMBER, LIKE_SPACE, LIKE_OTHER = "ª", "²", "\t", "!"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def frequent_lengths(path: str) -> dict[str, int]:
    """Token counts of the vocabulary entries that are one pre-token by themselves."""
    from tokenizers import Tokenizer

    tokenizer, alphabet = Tokenizer.from_file(path), byte_alphabet()
    whole, other = re.compile(PRETOKEN), re.compile(OTHER)
    entries = []
    for entry in tokenizer.get_vocab():
        try:
            text = bytes(alphabet[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        m = whole.match(text)
        if m and m.end() == len(text) and not other.search(text):
            entries.append(text)
    encoded = tokenizer.encode_batch_fast(entries, add_special_tokens=False)
    return {t: len(e.ids) for t, e in zip(entries, encoded, strict=True)}


class Lengths(dict):
    """Both tiers of one worker: pre-token to token count."""

    def __init__(self, frequent: dict[str, int], path: str, cache_entries: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(frequent)
        self.frequent, self.room = frequent, len(frequent) + cache_entries
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = all(not (t.lstrip or t.rstrip or t.single_word) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special and plain else None
        self.whole = bool(special) and not plain or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
        self.pretoken, self.other = re.compile(PRETOKEN), re.compile(OTHER)
        self.stand_in: dict[int, str] = {}

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, pretoken: str) -> int:
        n = self.encoded(pretoken)
        if len(pretoken) <= KEPT_CHARACTERS:
            if len(self) >= self.room:
                self.clear()
                self.update(self.frequent)
            self[pretoken] = n
        return n

    def kind(self, c: str) -> str:
        """The character that stands for ``c``: the library does not split ``c`` from its own kind."""
        for like in (LIKE_LETTER, LIKE_NUMBER, LIKE_OTHER):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(like + c + like)) == 1:
                return like
        return LIKE_SPACE

    def pretokens(self, text: str) -> Iterable[str]:
        others = {ord(c) for c in self.other.findall(text)}
        if others:
            for c in others - self.stand_in.keys():
                self.stand_in[c] = self.kind(chr(c))
            return (text[m.start() : m.end()] for m in self.pretoken.finditer(text.translate(self.stand_in)))
        return (m.group() for m in self.pretoken.finditer(text)) if len(text) > LONG else self.pretoken.findall(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole:
            return self.encoded(text)
        n, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        return n + sum(sum(map(self.__getitem__, self.pretokens(part))) for part in parts)


_WORKER: dict[str, Lengths] = {}


def token_counter(spark: SparkSession, path: str, cache_entries: int = 200_000):
    """A column function that gives the token count of a text column."""
    frequent = spark.sparkContext.broadcast(frequent_lengths(path))

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = _WORKER.get(path)
        if lengths is None:
            lengths = _WORKER[path] = Lengths(frequent.value, path, cache_entries)
        for texts in batches:
            yield pd.Series([lengths.count(t) for t in texts], dtype="int64")

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str | Column = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    column = F.col(text) if isinstance(text, str) else text
    count = token_counter(docs.sparkSession, path)
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(column).cast("long"), F.lit(0).cast("long")))
        .withColumn("n_tokens", count(column))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
