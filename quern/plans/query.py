"""The query language and its tree.

Tokens are separated by white space. ``+`` makes a token required, ``-`` excluded, else the mode decides. ``field:term``
names a field; a bare term means any default field. Terms are analysed, so one token can give several clauses or none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from quern.functions.analysis import analyse_text

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"
AND, OR = "and", "or"
_SIGN = {MUST: "+", SHOULD: "", MUST_NOT: "-"}


@dataclass(frozen=True)
class Term:
    """Exactly this term in this field; the term is not analysed."""

    field: str
    term: str

    def __str__(self) -> str:
        return f"{self.field}:{self.term}" if self.field else self.term

    def terms(self) -> Iterator[Term]:
        yield self


@dataclass
class Bool:
    """Clauses of (occurrence, node), nested at will."""

    clauses: list[tuple[str, Term | Bool]] = field(default_factory=list)

    def add(self, node: Term | Bool, occur: str = SHOULD) -> Bool:
        self.clauses.append((occur, node))
        return self

    def __str__(self) -> str:
        return "(" + " ".join(_SIGN[o] + str(n) for o, n in self.clauses) + ")"

    def terms(self) -> Iterator[Term]:
        for _, node in self.clauses:
            yield from node.terms()


def parse(text: str, default_fields: list[str], mode: str = AND) -> Bool:
    """The tree of a query string. Without default fields a bare term has no field and matches nothing."""
    root = Bool()
    for token in text.split():
        occur = {"+": MUST, "-": MUST_NOT}.get(token[0], MUST if mode == AND else SHOULD)
        token = token[1:] if token[0] in "+-" else token
        name, colon, rest = token.partition(":")
        qualified = bool(colon and name and rest)
        for term in analyse_text(rest if qualified else token):
            if qualified or not default_fields:
                root.add(Term(name if qualified else "", term), occur)
            elif occur == SHOULD:
                for f in default_fields:
                    root.add(Term(f, term))
            else:
                root.add(Bool([(SHOULD, Term(f, term)) for f in default_fields]), occur)
    return root
