r"""Secret scanning: fixed patterns, and a token-efficiency test for random strings.

The base patterns (assign, access, hex) are those of the contract. The method adds kind ``random``: runs of 20 or
more characters of keys whose characters per token under a byte-level BPE vocabulary are few (a vocabulary learned on
texts spends many tokens on random strings), unless the run is a known digest (hex of a digest's length, or listed),
an identifier (UUID, number, dotted and dashed words) or overlaps a base span. A run without a digit may be a long word, so it has to stay under a
stricter ratio, which long compounds of the four languages keep above. Limit: runs without a letter are numbers and are not measured.

The driver reads the vocabulary file (its path is a parameter) and broadcasts it, a fixed size. A long run is
measured in pieces of 256 characters, so its cost is linear.

Defined results: a null text is empty, without spans; equal rows get equal spans; other columns are carried along as ``row``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, ship

ship(__name__)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"(?ai:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_HEX_ONLY = re.compile(r"(?i)[0-9a-f]+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*+[/_=+-]*")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "key")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def identifier(run: str) -> bool:
    core = run.strip("=+/_-")
    if _HEX_ONLY.fullmatch(core) and (len(core) in _DIGEST_LENGTHS or core.isdigit()):
        return True
    return bool(_UUID.fullmatch(core) or not re.search("[A-Za-z]", core) or (_WORDS.fullmatch(core) and not core.isalpha()))


def random_spans(text: str, encoder, base: list[tuple[int, int, int]], most: float, known: frozenset[str], most_letters: float) -> list[tuple[int, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        if run in known or identifier(run) or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        tokens = sum(len(encoder.encode_ordinary(run[i : i + 256])) for i in range(0, len(run), 256))
        if len(run) <= (most if re.search("[0-9]", run) else most_letters) * tokens:
            out.append((m.start(), 3, m.end()))
    return out


def scan(docs: DataFrame, *, text_col: str = "text", vocabulary: str = VOCABULARY, chars_per_token: float = 2.2, letters_per_token: float = 2.0, known: frozenset[str] = frozenset()) -> DataFrame:
    """Each document as struct ``row`` with ``spans``: array of (kind, start, end) by start, then kind as listed."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for pdf in batches:
            spans = []
            for text in pdf["text"]:
                text = text or ""
                found = base_spans(text)
                found = sorted(found + random_spans(text, encoder, found, chars_per_token, known, letters_per_token))
                spans.append([(KINDS[k], s, e) for s, k, e in found])
            yield pd.DataFrame({"row": pdf["row"], "spans": pd.Series(spans, dtype=object)})

    rest = docs.select(F.struct(*[col(c) for c in docs.columns if c != text_col]).alias("row"), col(text_col).alias("text"))
    span = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    return rest.mapInPandas(run, T.StructType([rest.schema["row"]]).add("spans", T.ArrayType(span)))
