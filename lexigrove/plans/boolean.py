"""Boolean queries: infix to a tree, by precedence climbing; NOT binds before AND before OR."""

from __future__ import annotations

from dataclasses import dataclass

OPERATORS = {"OR": 2, "AND": 3, "NOT": 4}


@dataclass(frozen=True)
class Node:
    op: str  # TERM, NOT, AND, OR
    term: str = ""
    parts: tuple[Node, ...] = ()

    def leaves(self) -> list[str]:
        return [self.term] if self.op == "TERM" else list(dict.fromkeys(t for p in self.parts for t in p.leaves()))

    def rpn(self) -> str:
        return self.term if self.op == "TERM" else " ".join([*(p.rpn() for p in self.parts), self.op])

    def holds(self, present: set[str]) -> bool:
        """The value for a document that has these terms."""
        if self.op == "TERM":
            return self.term in present
        values = [p.holds(present) for p in self.parts]
        return not values[0] if self.op == "NOT" else all(values) if self.op == "AND" else any(values)

    def renamed(self, names: dict[str, str]) -> Node:
        return Node(self.op, names.get(self.term, self.term), tuple(p.renamed(names) for p in self.parts))


def parse(query: str) -> Node:
    """Raises ValueError on two terms in a row, an empty query or unbalanced parentheses."""
    words = query.replace("(", " ( ").replace(")", " ) ").split()
    at = 0

    def operand() -> Node:
        nonlocal at
        if at >= len(words):
            raise ValueError("a term is missing at the end of the query")
        word = words[at]
        at += 1
        if word == "NOT":
            return Node("NOT", parts=(operand(),))
        if word == "(":
            inner = expression(0)
            if at >= len(words) or words[at] != ")":
                raise ValueError("a parenthesis is not closed")
            at += 1
            return inner
        if word in OPERATORS or word == ")":
            raise ValueError(f"a term is missing before {word}")
        return Node("TERM", word)

    def expression(least: int) -> Node:
        nonlocal at
        left = operand()
        while at < len(words) and words[at] in ("AND", "OR") and OPERATORS[words[at]] >= least:
            op = words[at]
            at += 1
            left = Node(op, parts=(left, expression(OPERATORS[op] + 1)))
        return left

    tree = expression(0)
    if at < len(words):
        raise ValueError(f"unexpected {words[at]!r}")
    return tree


def to_postfix(query: str) -> str:
    return parse(query).rpn()
