"""Errors that requests end in."""

from __future__ import annotations

import json

#: Machine-readable codes (fixed values).
INVALID_JSON, VALIDATION, INTERNAL = "INVALID_JSON", "VALIDATION_ERROR", "INTERNAL_ERROR"


class RequestError(ValueError):
    def __init__(self, code: str, message: str, field: str | None = None):
        super().__init__(message)
        self.code, self.message, self.field = code, message, field

    def to_json(self) -> str:
        body = {"code": self.code, "message": self.message}
        return json.dumps({"error": body | ({"field": self.field} if self.field else {})})
