"""Weighted CNF text: parsing with exact weights and strict status."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

MOST_TOKEN, MOST_SCALE = 128, 2000
_DECIMAL = re.compile(r"([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?\Z")
_RATIO = re.compile(r"(-?[0-9]+)/(-?[0-9]+)\Z")


class ParseError(ValueError):
    status = "parse_error"


class Unsupported(ValueError):
    status = "unsupported_input"


class TooLarge(ValueError):
    status = "resource_limit"


def parse_weight(token: str) -> Fraction:
    """Fraction, decimal or scientific notation, exactly."""
    if not 0 < len(token) <= MOST_TOKEN:
        raise ParseError("weight length")
    if m := _RATIO.match(token):
        if int(m[2]) == 0:
            raise ParseError("zero denominator")
        return Fraction(int(m[1]), int(m[2]))
    m = _DECIMAL.match(token)
    if not m or not (m[2] or m[3]):
        raise ParseError(f"weight {token!r}")
    scale = int(m[4] or 0) - len(m[3] or "")
    if abs(scale) > MOST_SCALE:
        raise ParseError("weight scale")
    value = Fraction(int((m[2] or "") + (m[3] or "") or "0"))
    value *= Fraction(10) ** scale
    return -value if m[1] == "-" else value


@dataclass
class Formula:
    variables: int = 0
    clauses: list[tuple[int, ...]] = field(default_factory=list)
    weights: dict[int, tuple[Fraction, Fraction]] = field(default_factory=dict)  # variable -> (negative, positive)

    def weight(self, literal: int) -> Fraction:
        return self.weights.get(abs(literal), (Fraction(1), Fraction(1)))[literal > 0]


def clean_clause(literals: list[int]) -> tuple[int, ...] | None:
    """By variable, positive first, without repeats; None for a tautology."""
    unique = sorted(set(literals), key=lambda x: (abs(x), x < 0))
    return None if any(a == -b for a, b in zip(unique, unique[1:], strict=False)) else tuple(unique)


def parse(text: str | None, most_variables: int = 1_000_000, most_clauses: int = 10_000_000, most_literals: int = 100_000_000, most_bytes: int = 1 << 30, most_line: int = 1 << 26) -> Formula:
    """Parse ``p cnf``, ``c t wmc``, ``c p weight L W 0`` and clauses; ParseError (also for null), Unsupported or TooLarge (sizes in characters) otherwise."""
    if text is None:
        raise ParseError("no text")
    if len(text) > most_bytes:
        raise TooLarge("text")
    read = 0
    f, declared, given, open_clause, count = Formula(), None, {}, [], 0
    for line in text.split("\n"):
        if len(line) > most_line:
            raise TooLarge("line")
        fields = line.split()
        if not fields:
            continue
        if fields[0] == "c":
            if fields[1:2] == ["t"]:
                if len(fields) != 3:
                    raise ParseError("problem type line")
                if fields[2] != "wmc":
                    raise Unsupported("problem type")
            if fields[1:2] == ["p"]:
                if len(fields) < 3:
                    raise ParseError("weight line")
                if fields[2:3] != ["weight"]:
                    raise Unsupported(" ".join(fields[:3]))
                if len(fields) != 6 or fields[5] != "0" or not re.fullmatch(r"-?[0-9]+", fields[3]) or int(fields[3]) == 0:
                    raise ParseError("weight line")
                if int(fields[3]) in given:
                    raise ParseError("weight given twice")
                given[int(fields[3])] = parse_weight(fields[4])
            continue
        if fields[0] == "p":
            if declared is not None or len(fields) != 4 or fields[1] != "cnf" or not all(x.isdigit() for x in fields[2:]):
                raise ParseError("header")
            f.variables, declared = int(fields[2]), int(fields[3])
            if f.variables > most_variables or declared > most_clauses:
                raise TooLarge("declared size")
            continue
        if declared is None:
            raise ParseError("clause before header")
        for token in fields:
            if not re.fullmatch(r"-?[0-9]+", token):
                raise ParseError(f"literal {token!r}")
            literal = int(token)
            read += literal != 0
            if read > most_literals:
                raise TooLarge("literals")
            if literal == 0:
                count += 1
                if (clause := clean_clause(open_clause)) is not None:
                    f.clauses.append(clause)
                open_clause = []
            elif abs(literal) > f.variables:
                raise ParseError("variable out of range")
            else:
                open_clause.append(literal)
    if declared is None or open_clause or count != declared:
        raise ParseError("clause count")
    for v in {abs(x) for x in given}:
        if v > f.variables:
            raise ParseError("weight of unknown variable")
        if (v in given) != (-v in given):
            raise Unsupported("one-sided weight")
        lo, hi = given[-v], given[v]
        if min(lo, hi) < 0 or max(lo, hi) > 1 or (lo + hi != 1 and (lo, hi) != (1, 1)):
            raise Unsupported("weights")
        f.weights[v] = (lo, hi)
    return f
