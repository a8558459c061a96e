"""Secret scans: keywords by an Aho-Corasick automaton, regular expressions near hits, checksums.

1. One pass of an automaton over a whole text finds the keywords of all rules, a second one over
   a folded copy of the same length those of rules for any case. Most texts have none and are
   done.
2. A rule's expression is anchored: it is tried at the places its keywords hit and nowhere
   else (``back`` characters before the keyword for rules whose match begins earlier).
3. Tokens with an embedded checksum are validated: CRC-32 in base 62 (tokens of code hosts and
   package registries), Luhn's sum (payment cards), modulo 97 (bank accounts), and the JSON
   header of web tokens. A failed checksum is reported as such, not dropped.

The secret itself isn't put out: a finding has its place, its length and a SHA-256 prefix, by
which the same secret can be told in several texts.

Defined cases. A null or empty text has no findings. Where matches of one rule overlap, the
first from the left is kept; different rules may report the same place. Repeated rows report
alike; extra columns don't matter.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62(secret: str) -> bool:
    """Whether the last six characters are the CRC-32, in base 62, of those after the prefix."""
    body = secret.split("_", 1)[1]
    n, out = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return body[-6:] == out


def luhn(secret: str) -> bool:
    digits = [int(c) for c in secret if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def mod97(secret: str) -> bool:
    s = secret.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def jwt_header(secret: str) -> bool:
    part = secret.split(".", 1)[0]
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(head, dict) and "alg" in head


@dataclass(frozen=True)
class Rule:
    """``pattern`` must match at ``back`` or fewer characters before a keyword; group 1, if any, is the secret.
    With ``any_case`` both ignore case, and keywords are given in lower case."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    checksum: Callable[[str], bool] | None = None
    back: int = 0
    any_case: bool = False


_END = r"(?![A-Za-z0-9_])"
#: Account numbers of any country: two letters and a digit.
_IBAN = tuple(f"{a}{b}{d}" for a in string.ascii_uppercase for b in string.ascii_uppercase for d in string.digits)
#: The first four digits of cards with four groups of four.
_CARD = r"(?:4\d{3}|5[1-5]\d\d|6011|65\d\d)"
RULES = (
    Rule("code_host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}" + _END, crc62),
    Rule("registry_token", ("npm_",), r"npm_[A-Za-z0-9]{36}" + _END, crc62),
    Rule("cloud_access_key", ("AKIA", "ASIA"), r"A[KS]IA[A-Z2-7]{16}" + _END),
    Rule("api_key_live", ("sk_live_", "rk_live_"), r"[sr]k_live_[A-Za-z0-9]{16,}" + _END),
    Rule("maps_api_key", ("AIza",), r"AIza[A-Za-z0-9_\-]{35}(?![A-Za-z0-9_\-])"),
    Rule("chat_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"xox[bpars]-[A-Za-z0-9\-]{10,}"),
    Rule("private_key", ("-----BEGIN",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", ("eyJ",), r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*", jwt_header),
    Rule(
        "assigned_secret", ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key"),
        r"(?:token|secret|password|passwd|api_?key|access_key)[A-Za-z_]{0,20}['\"]?\s{0,4}(?::=|=>|=|:)\s{0,4}['\"]([A-Za-z0-9+/=_\-.]{16,})['\"]",
        any_case=True,
    ),
    Rule("payment_card", tuple(f"{d}{e}" for d in "3456" for e in "0123456789"), rf"(?<![\d.])(?:4\d{{15}}|5[1-5]\d{{14}}|3[47]\d{{13}}|6(?:011|5\d\d)\d{{12}}|{_CARD}(?:(?: \d{{4}}){{3}}|(?:-\d{{4}}){{3}})|3[47]\d\d(?: \d{{6}} |-\d{{6}}-)\d{{5}})(?![\d.]\d|\d)", luhn),
    Rule("bank_account", _IBAN, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97),
)


def fold(text: str) -> str:
    """Lower case, character for character; i, k and s have other forms that expressions for any case match."""
    return text.replace("\u0130", "i").lower().replace("\u0131", "i").replace("\u017f", "s")


class Scanner:
    """All rules, compiled once for a worker."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, re.IGNORECASE if r.any_case else 0)) for r in rules]
        self.automata = [(self._automaton(any_case), any_case) for any_case in (False, True) if any(r.any_case == any_case for r in rules)]

    def _automaton(self, any_case: bool) -> ahocorasick.Automaton:
        of: dict[str, list[int]] = {}
        for i, (r, _) in enumerate(self.rules):
            if r.any_case == any_case:
                for k in r.keywords:
                    of.setdefault(k, []).append(i)
        out = ahocorasick.Automaton()
        for k, which in of.items():
            out.add_word(k, (len(k), tuple(which)))
        out.make_automaton()
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, str, bool | None]]:
        """(rule, start, end, secret, checksum verdict) of all findings, by place and rule."""
        tried: dict[int, set[int]] = {}
        for automaton, any_case in self.automata:
            for end, (size, which) in automaton.iter(fold(text) if any_case else text):
                for i in which:
                    tried.setdefault(i, set()).add(end - size + 1)
        out = []
        for i, places in tried.items():
            rule, pattern = self.rules[i]
            free = 0
            for at in sorted({max(0, p - b) for p in places for b in range(rule.back + 1)}):
                if at >= free and (m := pattern.match(text, at)):
                    free = m.end()
                    group = 1 if m.re.groups else 0
                    secret = m.group(group)
                    out.append((rule.name, m.start(group), m.end(group), secret, rule.checksum(secret) if rule.checksum else None))
        return sorted(out, key=lambda f: (f[1], f[0]))


_scanners: list[Scanner] = []
_COLUMNS = ["rule", "start", "end", "fingerprint", "checksum_valid"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanners:
        _scanners.append(Scanner())
    for batch in batches:
        rows, found = [], []
        for n, text in enumerate(batch.column("text")):
            if text.is_valid:
                for f in _scanners[0].scan(text.as_py()):
                    rows.append(n)
                    found.append(f)
        yield pa.record_batch([
            batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
            pa.array([f[2] for f in found], pa.int64()), pa.array([hashlib.sha256(f[3].encode()).hexdigest()[:16] for f in found], pa.string()), pa.array([f[4] for f in found], pa.bool_()),
        ], ["doc_id", *_COLUMNS])


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rule, start, end, fingerprint, checksum_valid) of every finding: places in
    characters, and null where a rule has no checksum. See the module."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kinds = [T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()]
    return narrow.mapInArrow(_scan, T.StructType([narrow.schema["doc_id"], *(T.StructField(c, k) for c, k in zip(_COLUMNS, kinds))]))
