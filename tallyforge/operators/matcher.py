"""Many patterns against descriptions in one pass.

Every rule pattern is an alternation of mostly literal texts.  Each alternative has a literal factor
that must occur wherever the pattern matches; one automaton over the factors of all patterns
(Aho-Corasick) reads a description once and proposes the patterns that can match it, however many
patterns there are.  A pattern made of literals only is decided by the automaton; for any other one the
regular expression decides, in the JVM, on the proposed rows alone.  Only the description (and the
account, where entries name one) goes through Python, as Arrow batches, and equal descriptions of a
batch are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Characters with a meaning of their own in a regular expression.
LIVE = set(".^$?{}[]|\\*+()")


def literal_factor(alternative: str) -> tuple[str, bool]:
    """(longest literal run that any match must contain, whether the alternative is that run alone).
    Anything but plain characters and escaped ones only ever shortens the run; groups give none."""
    runs, run, whole, i = [], "", True, 0
    while i < len(alternative):
        ch = alternative[i]
        if ch == "\\" and i + 1 < len(alternative) and not alternative[i + 1].isalnum():
            run, i = run + alternative[i + 1], i + 2
            continue
        if ch not in LIVE:
            run, i = run + ch, i + 1
            continue
        whole = False
        if ch in "()\\":                      # groups, classes and quotings by letter: no promise
            return "", False
        if ch in "?*+{":                      # the character before it may be absent or repeated
            runs.append(run[:-1])
            i = alternative.find("}", i) + 1 if ch == "{" else i + 1
            if i == 0:
                return "", False
        elif ch == "[":
            end = alternative.find("]", i + 2)
            if end < 0 or "[" in alternative[i + 1:end] or "&&" in alternative[i + 1:end]:
                return "", False
            runs.append(run)
            i = end + 1
        else:                                 # . ^ $ and stray closers
            runs.append(run)
            i += 1
        run = ""
    return max([*runs, run], key=len), whole


def factors(regex: str) -> tuple[list[str], bool] | None:
    """(a factor per alternative, whether an occurrence of one decides), or None when some
    alternative has no factor, so every description is a candidate."""
    parts, part, i, depth = [], "", 0, 0
    while i < len(regex):
        ch = regex[i]
        if ch == "\\":
            part, i = part + regex[i:i + 2], i + 2
            continue
        depth += (ch == "[") - (ch == "]" and depth > 0)
        if ch == "|" and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += ch
        i += 1
    found = [literal_factor(p) for p in [*parts, part]]
    if any(not text for text, _ in found):
        return None
    return [text for text, _ in found], all(whole for _, whole in found)


def always_matches(regex: str) -> bool:
    """An empty alternative matches every non-null description."""
    return regex == "" or regex.startswith("|") or (regex.endswith("|") and not regex.endswith("\\|")) or "||" in regex


def _proposer(entries: Sequence[tuple[str | None, str]]):
    """The Arrow function: (descriptions, accounts) -> per row the numbers of the entries to consider.
    ``entries`` are (account or None for all, regex).  Self-contained: shipped by value."""
    words: dict[str, list[int]] = {}
    every = []
    numbers: dict[str, list[int]] = {}
    for n, (_, regex) in enumerate(entries):
        numbers.setdefault(regex, []).append(n)
    for regex, ns in numbers.items():
        found = None if always_matches(regex) else factors(regex)
        if found is None:
            every.extend(ns)
        else:
            for text in set(found[0]):
                words.setdefault(text, []).extend(ns)
    owner = [a for a, _ in entries]

    def propose(batches):
        import ahocorasick
        import numpy as np
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        for text, ns in words.items():
            machine.add_word(text, ns)
        if words:
            machine.make_automaton()

        def read(text):
            """(entries of every account, {account: its entries}) that can match a description"""
            if text is None:
                return (), None
            hits = set(every)
            if words:
                for _, ns in machine.iter(text):
                    hits.update(ns)
            named: dict = {}
            for n in sorted(hits):
                if owner[n] is not None:
                    named.setdefault(owner[n], []).append(n)
            return tuple(sorted(n for n in hits if owner[n] is None)), named or None

        for text, account in batches:
            code = text.dictionary_encode()
            known = [read(t) for t in code.dictionary.to_pylist()]
            nothing = ((), None)
            out, sizes = [], np.zeros(len(text) + 1, np.int64)
            accounts = account.to_pylist() if any(named for _, named in known) else None
            for i, c in enumerate(code.indices.to_pylist()):
                general, named = known[c] if c is not None else nothing
                out.extend(general)
                sizes[i + 1] = len(general)
                if named:
                    own = named.get(accounts[i], ())
                    out.extend(own)
                    sizes[i + 1] += len(own)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(out, pa.int32()))

    return propose


def matching_entries(rows: DataFrame, entries: Sequence[tuple[str | None, str]], out: str = "entry",
                     text: str = "description", account: Column | str = "account") -> DataFrame:
    """One row per (row, matching entry): ``rows`` plus ``out``, the entry's number.  ``entries`` are
    (account or None for every account, regex); they are configuration, held by the driver."""
    entries = list(entries)
    if not entries:
        return rows.withColumn(out, F.lit(None).cast("int")).where(F.lit(False))
    account = F.col(account) if isinstance(account, str) else account
    candidates = F.arrow_udf(_proposer(entries), T.ArrayType(T.IntegerType()), F.ArrowUDFType.SCALAR_ITER)
    hit = rows.select("*", F.explode(candidates(F.col(text), account.cast("string"))).alias(out))
    # the regular expressions that an occurrence of a factor does not decide
    checks = [None if always_matches(r) or (factors(r) or ([], False))[1] else r for _, r in entries]
    if any(c is not None for c in checks):
        regex = F.element_at(F.array(*[F.lit(c).cast("string") for c in checks]), F.col(out) + 1)
        hit = hit.where(regex.isNull() | F.rlike(F.col(text), regex))
    return hit


SLICE_CHARACTERS = 16 << 20


def matching_patterns(rows: DataFrame, patterns: DataFrame, out: str = "regex", text: str = "description") -> DataFrame:
    """One row per (row, distinct pattern of the column ``regex`` that its text matches), for pattern tables
    of any length: they are read in slices of at most ``SLICE_CHARACTERS`` (or one pattern), one pass over
    the rows each, so neither the driver nor a task ever holds more than a slice."""
    found, held, size = [], [], 0
    distinct = patterns.select("regex").where("regex is not null").distinct()

    def pass_over(slice_: list[str], only: bool) -> DataFrame:
        hit = matching_entries(rows, [(None, r) for r in slice_], "_entry", text, F.lit(None))
        name = F.element_at(F.array(*[F.lit(r) for r in slice_]), F.col("_entry") + 1)
        hit = hit.select(*rows.columns, name.alias(out))
        return hit if only else materialize(hit, "matches")

    for row in distinct.toLocalIterator():
        if held and size + len(row["regex"]) > SLICE_CHARACTERS:
            found.append(pass_over(held, only=False))
            held, size = [], 0
        held.append(row["regex"])
        size += len(row["regex"])
    if held or not found:
        found.append(pass_over(held, only=not found) if held else rows.withColumn(out, F.lit(None).cast("string")).where(F.lit(False)))
    out_rows = found[0]
    for f in found[1:]:
        out_rows = out_rows.unionByName(f)
    return out_rows
