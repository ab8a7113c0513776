"""What is wrong with a request or query, as reported to the user."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Problem:
    error: str
    context: str | None = None

    def to_json(self) -> dict[str, str]:
        return {"error": self.error} | ({"context": self.context} if self.context is not None else {})


class QueryError(Exception):
    """One or more problems that keep a request from being carried out."""

    def __init__(self, *problems: Problem | str):
        self.problems = [Problem(p) if isinstance(p, str) else p for p in problems]
        super().__init__("; ".join(p.error for p in self.problems))


def problems_json(problems: list[Problem]) -> dict:
    return {"problems": [p.to_json() for p in problems]}
