"""URL filter: domain rules, then a weighted vocabulary found by Aho-Corasick.

One automaton finds all terms, in the singular and plural, in one pass over a URL. A term
counts only as a whole word: no ASCII letter or digit before or after it. One strict term
rejects; soft terms reject when the weights of the distinct ones found reach a limit.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from airsift.llm.common import column, map_rows

MAX_RULES = 1_000_000
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


# Words by what they sell, in the singular. Fixed values.
STRICT_WORDS = """
porn porno pornstar xxx hentai camgirl sexcam milf blowjob bukkake gangbang creampie upskirt
warez keygen nulled scat cumshot fisting shemale bestiality incest
"""
SOFT_WORDS = {
    "gambling": """
    bet betting bookie bookmaker casino jackpot roulette blackjack baccarat poker slot wager
    sportsbook gamble gambling lottery lotto bingo freespin croupier punter handicapper
    """,
    "adult": """
    adult nude naked sex sexy erotic erotica escort fetish bdsm lingerie swinger hookup webcam
    striptease stripper topless uncensored horny kinky amateur babe
    """,
    "pharmacy": """
    pill viagra cialis levitra xanax valium tramadol ambien phentermine oxycontin hydrocodone
    steroid kamagra sildenafil tadalafil pharmacy prescriptionless enlargement slimming detox
    """,
    "money": """
    loan payday lender cash cashback profit earning millionaire forex crypto bitcoin airdrop
    giveaway bonus investor refinance debt mortgage moneymaker pyramid
    """,
    "fakes": """
    replica counterfeit knockoff fake rolex vuitton diploma degree passport essay termpaper
    coursework ghostwriter
    """,
    "downloads": """
    crack cracked torrent serial codec cheat hack generator unlocker pirated leaked ripped
    bootleg activator
    """,
    "traffic": """
    spam farm ads adserver clickbait backlink doorway popup popunder redirect affiliate
    autosurf traffic track tracker linkbuilding
    """,
    "bait": """
    free cheap cheapest hot win winner winning prize discount unlimited miracle secret
    guaranteed instant exclusive dating singles
    """,
}
_WEIGHTS = {"bait": 1.0, "traffic": 1.0}


def forms(word: str) -> list[str]:
    """A word and its plural."""
    if word.endswith(("s", "x", "ch", "sh")):
        return [word, word + "es"]
    if word.endswith("y") and word[-2:-1] not in "aeiou":
        return [word, word[:-1] + "ies"]
    return [word, word + "s"]


def _soft() -> dict[str, float]:
    return {w: _WEIGHTS.get(kind, 1.5) for kind, some in SOFT_WORDS.items() for w in some.split()}


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case, each with the forms of `forms`, which are one term. `limit`: total
    weight of distinct soft terms that rejects; no term of the default reaches it alone, and
    any two do."""

    strict: tuple[str, ...] = tuple(STRICT_WORDS.split())
    soft: Mapping[str, float] = field(default_factory=_soft)
    limit: float = 2.0

    def listed(self) -> dict[str, tuple[str, float, bool]]:
        """Term, weight and strictness of every form; a form of two terms is that of the strict
        one, or of the first, and a term that is listed is its own."""
        found: dict[str, tuple[str, float, bool]] = {}
        terms = [(t, self.limit, True) for t in self.strict]
        terms += [(t, w, False) for t, w in self.soft.items() if t not in self.strict]
        for term, weight, strict in terms:
            found[term] = term, weight, strict
        for term, weight, strict in terms:
            for form in forms(term):
                found.setdefault(form, (term, weight, strict))
        return found


def lowered(text: str) -> str:
    """A-Z in lower case, everything else as it is."""
    return text.translate(_LOWER)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to /, ?, # or the end; path: from there up to ?, # or
    the end. Both empty for null and without ://."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return lowered(host), slash + path


class Rules:
    """Allow and block rules like `example.net/en/`: a host with its subdomains, and the
    start of a path. The longest that fits decides, of equals the smaller text."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        count = 0
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"rule verdict {verdict!r}")
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(lowered(host), []).append((slash + path, rule, verdict))
            count += 1
            if count > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules: too large to send to every task")
        for found in self.by_host.values():
            found.sort(key=lambda r: (-len(r[1]), r[1]))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str, str] | None = None
        at = host
        while at:
            for start, rule, verdict in self.by_host.get(at, ()):
                if path.startswith(start):
                    if not best or (-len(rule), rule) < (-len(best[0]), best[0]):
                        best = rule, verdict
                    break
            at = at.partition(".")[2]
        return best or (None, None)


class Terms:
    """The automaton over all terms."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.limit = vocabulary.limit
        self.automaton = ahocorasick.Automaton()
        for form, found in vocabulary.listed().items():
            self.automaton.add_word(form, (len(form), *found))
        if len(self.automaton):
            self.automaton.make_automaton()

    def judge(self, url: str) -> tuple[int, int, float, bool]:
        """Distinct strict terms, distinct soft terms, soft weight, rejected."""
        low = lowered(url)
        found = {}
        for end, (size, term, weight, strict) in self.automaton.iter(low) if len(self.automaton) else ():
            start = end + 1 - size
            if (start and low[start - 1] in _WORD) or (end + 1 < len(low) and low[end + 1] in _WORD):
                continue
            found[term] = weight, strict
        strict = sum(s for _, s in found.values())
        soft = sum(w for w, s in found.values() if not s)
        return strict, len(found) - strict, float(soft), bool(strict) or soft >= self.limit


RESULT = (
    "host string, path string, rule string, verdict string, n_strict int, n_soft int, "
    "soft_weight double"
)


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]] = (),
    vocabulary: Vocabulary = Vocabulary(),
    url: str = "url",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add host, path, rule, verdict and the term counts to every row.

    A null URL, or one without ://, has an empty host and path and fits no rule; terms are
    still sought in the text there is, a null has none and is allowed. Terms count once per
    URL whatever their repetitions. Whole URLs are read; repeated rows are judged one by one;
    an input column with the name of a result column is replaced; an empty table gives an
    empty table. One narrow pass without a shuffle that reads the URL column; rules and
    terms are parameters of bounded number.
    """
    listed = list(rules)
    Rules(listed)  # fails on the driver if there are too many

    built: list[tuple[Rules, Terms]] = []  # once per task

    def judge(batch: pa.RecordBatch) -> list:
        if not built:
            built.append((Rules(listed), Terms(vocabulary)))
        known, terms = built[0]
        rows = []
        for value in column(batch, url).to_pylist():
            host, path = host_and_path(value)
            rule, verdict = known.find(host, path)
            strict, soft, weight, rejected = terms.judge(value or "")
            verdict = verdict or ("block" if rejected else "allow")
            rows.append((host, path, rule, verdict, strict, soft, weight))
        return list(zip(*rows, strict=True)) if rows else [[]] * 7

    return map_rows(pages, RESULT, judge, keep)
