"""Secrets in texts: keyword automaton, regular expressions anchored at its hits, embedded checksums."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded, id_text

SCHEMA = "doc_id long, rule string, start int, end int, checksum string, fingerprint string"
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62(token: str) -> bool:
    """Six base-62 digits at the end are the CRC-32 of what is between the prefix and them."""
    body, n = token.partition("_")[2], 0
    for c in body[-6:]:
        n = n * 62 + _BASE62.index(c)
    return n == zlib.crc32(body[:-6].encode())


def signed_json(token: str) -> bool:
    """The first part is base64url of a JSON object that names an algorithm."""
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def macaroon(token: str) -> bool:
    """The body is base64url of a macaroon of version 2 whose location names the package index."""
    body = token.partition("-")[2]
    try:
        raw = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    except ValueError:
        return False
    return raw[:2] == b"\x02\x01" and b"pypi.org" in raw[:16]


def key_bytes(n: int):
    """Base64 of exactly ``n`` bytes."""

    def check(token: str) -> bool:
        try:
            return len(base64.b64decode(token, validate=True)) == n
        except ValueError:
            return False

    return check


def random_looking(value: str) -> bool:
    """Letters and digits, with the spread of a random string."""
    spread = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and spread >= 2.5


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried at each keyword's place only; its group 1 is the secret. ``check`` must hold where given.

    ``embedded``: the check reads a checksum in the secret, so what passes is reported as valid. ``named``: the keyword
    is part of a name, in which a capital after a small letter begins a word.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[str], bool] | None = None
    embedded: bool = False
    named: bool = False


def _cases(*words: str) -> tuple[str, ...]:
    return tuple(x for w in words for x in dict.fromkeys((w, w.upper(), w.capitalize())))


RULES = (
    Rule("aws_access_key_id", ("AKIA", "ASIA"), r"((?:AKIA|ASIA)[A-Z2-7]{16})(?![A-Za-z0-9])"),
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])", crc62, True),
    Rule("npm_token", ("npm_",), r"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])", crc62, True),
    Rule("json_web_token", ("eyJ",), r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", signed_json, True),
    Rule("gitlab_token", ("glpat-",), r"(glpat-[A-Za-z0-9_-]{20,})"),
    Rule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"(xox[bpars]-[A-Za-z0-9-]{20,})"),
    Rule("google_api_key", ("AIza",), r"(AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])"),
    Rule("stripe_key", ("sk_live_", "rk_live_"), r"([sr]k_live_[A-Za-z0-9]{20,})"),
    Rule("stripe_webhook_secret", ("whsec_",), r"(whsec_[A-Za-z0-9+/=]{24,})"),
    Rule("github_fine_grained_token", ("github_pat_",), r"(github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59})(?![A-Za-z0-9])"),
    Rule("pypi_token", ("pypi-AgE",), r"(pypi-AgE[A-Za-z0-9_-]{50,})", macaroon, True),
    Rule("huggingface_token", ("hf_",), r"(hf_[A-Za-z]{34})(?![A-Za-z0-9])"),
    Rule("sendgrid_key", ("SG.",), r"(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})(?![A-Za-z0-9_-])"),
    Rule("twilio_key", ("SK",), r"(SK[0-9a-f]{32})(?![A-Za-z0-9])", lambda t: len(set(t[2:])) >= 8),
    Rule("digitalocean_token", ("dop_v1_", "doo_v1_", "dor_v1_"), r"(do[opr]_v1_[0-9a-f]{64})(?![A-Za-z0-9])"),
    Rule("shopify_token", ("shpat_", "shpca_", "shppa_", "shpss_"), r"(shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32})(?![A-Za-z0-9])"),
    Rule("google_oauth_secret", ("GOCSPX-",), r"(GOCSPX-[A-Za-z0-9_-]{28})(?![A-Za-z0-9_-])"),
    Rule("azure_storage_key", ("AccountKey=",), r"AccountKey=([A-Za-z0-9+/]{86}==)", key_bytes(64), True),
    Rule("slack_webhook", ("hooks.slack.com/services/",), r"(hooks\.slack\.com/services/T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{20,})"),
    Rule("url_password", ("://",), r"://[^\s/:@\"'<>]{1,}:([^\s/:@\"'<>]{4,})@[A-Za-z0-9\[]", lambda t: not re.fullmatch(r"[*x.$<>{}\[\]]+|(?i:password|pass|pwd|secret)", t)),
    # without its last line the key ends where its base64 does
    Rule("private_key", ("-----BEGIN ",), r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*-----END (?:[A-Z]+ )?PRIVATE KEY-----|(?:\s*(?:[A-Za-z-]+: [^\n]*\n|[A-Za-z0-9+/=]{16,}))*(?:\s+[A-Za-z0-9+/]+={1,2})?))"),
    Rule(
        "assigned_secret",
        (*_cases("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key"), "apiKey", "ApiKey"),
        r"[\w-]*+[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>]{8,})",
        random_looking,
        named=True,
    ),
)


_NAME = re.compile(r"[\w-]*")


class Scanner:
    """One automaton over all keywords; each pattern runs at the hits of its own keywords."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        import ahocorasick

        self.rules = rules
        self.patterns = [re.compile(r.pattern) for r in rules]
        words: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            for word in rule.keywords:
                words.setdefault(word, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for word, owners in words.items():
            self.automaton.add_word(word, (len(word), tuple(owners)))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, rule, checksum) of every secret, in order; ``checksum`` is "valid", or "none" where the format has none."""
        found, named = set(), {}
        for last, (size, owners) in self.automaton.iter(text):
            at = last - size + 1
            within = at and text[at - 1].isalnum() and text[at].isalnum()
            capital = within and text[at - 1].islower() and text[at].isupper()
            for k in owners:
                rule = self.rules[k]
                if within and not (rule.named and capital):
                    continue
                if rule.named:
                    if at < named.get(k, 0):  # a name of several keywords has one value
                        continue
                    named[k] = _NAME.match(text, at).end()
                m = self.patterns[k].match(text, at)
                if m and (rule.check is None or rule.check(m[1])):
                    found.add((m.start(1), m.end(1), rule.name, "valid" if rule.embedded else "none"))
        return sorted(found)

    def redact(self, text: str) -> str:
        """``text`` with every secret replaced by the name of its rule; overlapping finds are one."""
        out, done = [], 0
        for start, end, name, _ in self.find(text):
            if start >= done:
                out += [text[done:start], f"[{name}]"]
            done = max(done, end)
        return "".join([*out, text[done:]]) if out else text


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a secret: document, rule, place in characters (end exclusive), checksum, and a hash in its stead.

    A whole text is searched by one keyword automaton, and patterns are tried only where their keyword begins a word.
    The names of assigned secrets go on in any word characters, and their values are of any length. A key block without
    its last line goes on as long as its base64 does.
    A find whose embedded checksum is wrong is no secret. The secret itself is never returned. Null and empty texts
    have none; overlapping finds of different rules each have a row; null ids and repeated rows are searched like any
    other. An empty table gives no row. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if text:
                    rows += [(i, name, a, z, checksum, hashlib.sha256(text[a:z].encode()).hexdigest()[:16]) for a, z, name, checksum in scanner().find(text)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "rule", "start", "end", "checksum", "fingerprint"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same rows and columns, with every secret of ``text_col`` replaced; other texts, null among them, stay as they are.

    Where a text changes, ``length_col`` (if there is one) becomes its new length in characters.
    """
    counted = length_col if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            before = b.column(k).to_pylist()
            after = [scanner().redact(t) if t else t for t in before]
            b = b.set_column(k, b.schema.field(k), pa.array(after, b.schema.field(k).type))
            if counted:
                k = b.schema.get_field_index(counted)
                sizes = [n if x is y or x == y else len(y) for n, x, y in zip(b.column(k).to_pylist(), before, after)]
                b = b.set_column(k, b.schema.field(k), pa.array(sizes, b.schema.field(k).type))
            yield b

    return bounded(docs).mapInArrow(run, docs.schema)
