"""Errors: every refusal has a code, and a refusal is never an empty result."""


class QueryError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def refuse(code: str, message: str):
    raise QueryError(code, message)
