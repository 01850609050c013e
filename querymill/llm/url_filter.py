"""URL filter: host and path rules, then a weighted vocabulary.

Defined cases: a null url has an empty host and path, fits no rule and is
allowed; one without ``://`` has no host and path either, and the vocabulary
judges it; a very long url is read whole; of rules of one length that fit, the
first of the policy wins; an empty table gives an empty result; repeated
rows are judged alike; further columns are kept, and those named like a result
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from querymill.llm.session import prepare

# Rules of the production filter (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# One strict term rejects a url.
STRICT = ("cheap-pills", "spam-farm", "casino-win", "free-bets", "adult-x", "porn", "viagra", "malware", "phishing")
# Soft terms with weights.
SOFT = {"pills": 2, "casino": 2, "bets": 2, "betting": 2, "adult": 2, "spam": 2, "xxx": 2, "cheap": 1, "free": 1, "win": 1, "bonus": 1, "farm": 1, "loan": 1, "ads": 1}
#: So many distinct soft terms, of this weight together, reject.
SOFT_TERMS, SOFT_WEIGHT = 2, 3


@dataclass(frozen=True)
class UrlPolicy:
    rules: Sequence[tuple[str, str, str]] = RULES
    strict: Sequence[str] = STRICT
    soft: tuple[tuple[str, int], ...] = tuple(SOFT.items())
    soft_terms: int = SOFT_TERMS
    soft_weight: int = SOFT_WEIGHT


def lower_ascii(s: str) -> str:
    return s.translate({c: c + 32 for c in range(65, 91)})


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return lower_ascii(rest[:end]), path[:stop]


class UrlJudge:
    """The policy compiled for one Python worker."""

    def __init__(self, policy: UrlPolicy):
        self.policy = policy
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in policy.rules:
            self.rules.setdefault(host, []).append((path, verdict))
        weight = dict(policy.soft)
        self.machine = ahocorasick.Automaton()
        for term in {*policy.strict, *weight}:
            self.machine.add_word(term, (term, term in policy.strict, weight.get(term, 0)))
        self.machine.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, as host and path in one string, and its verdict."""
        best: tuple[int, str, str] | None = None
        labels = host.split(".")
        for i in range(len(labels)) if host else ():
            suffix = ".".join(labels[i:])
            for start, verdict in self.rules.get(suffix, ()):
                if path.startswith(start) and (best is None or len(suffix + start) > best[0]):
                    best = (len(suffix + start), suffix + start, verdict)
        return best[1:] if best else (None, None)

    def terms(self, url: str | None) -> tuple[int, int, int]:
        """Strict hits, distinct soft terms, and the weight of those.

        A term counts where no ASCII letter or digit stands beside it.
        """
        s = lower_ascii(url or "")
        strict, soft = 0, {}
        for end, (term, is_strict, weight) in self.machine.iter(s):
            start = end - len(term) + 1
            if any(c.isascii() and c.isalnum() for c in s[start - 1 : start] + s[end + 1 : end + 2]):
                continue
            strict += is_strict
            if weight:
                soft[term] = weight
        return strict, len(soft), sum(soft.values())

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int, int]:
        host, path = host_and_path(url)
        rule, verdict = self.rule(host, path)
        strict, distinct, weight = self.terms(url)
        if verdict is None:
            bad = strict or (distinct >= self.policy.soft_terms and weight >= self.policy.soft_weight)
            verdict = "block" if bad else "allow"
        return host, path, rule, verdict, strict, distinct, weight


RESULT = T.StructType(
    [T.StructField(k, T.StringType()) for k in ("host", "path", "rule", "verdict")] + [T.StructField(k, T.LongType()) for k in ("strict_hits", "soft_terms", "soft_weight")]
)


def filter_urls(pages: DataFrame, policy: UrlPolicy | None = None, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and the vocabulary's counts; a map without any shuffle."""
    prepare(pages.sparkSession)
    policy = policy or UrlPolicy()
    pages = pages.drop(*RESULT.names)  # in any case of their letters
    own = pages.schema.fields
    schema = T.StructType([*own, *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(policy)
        for b in batches:
            rows = [judge.judge(u) for u in b.column(url_col).to_pylist()]
            found = list(zip(*rows)) if rows else [()] * len(RESULT.names)
            kinds = [pa.string()] * 4 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in own), *(pa.array(v, k) for v, k in zip(found, kinds))], names=schema.names)

    return pages.select(*(f.name for f in own)).mapInArrow(run, schema)
