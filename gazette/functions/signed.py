"""Signed tokens (JWT, HS256) for links that unsubscribe a reader."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KIND, DAYS = "unsubscribe", 90


def _part(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _raw(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def signed(user: str, now: int, secret: str, days: int = DAYS) -> str:
    head = _part(json.dumps({"alg": "HS256", "typ": "JWT"}, separators=(",", ":")).encode())
    body = _part(json.dumps({"sub": user, "exp": now + days * 86400, "type": KIND}, separators=(",", ":")).encode())
    return f"{head}.{body}.{_part(hmac.new(secret.encode(), f'{head}.{body}'.encode(), hashlib.sha256).digest())}"


def subject(token: str | None, now: int, secret: str) -> str | None:
    """Whom a token is for; None if it is broken, forged, of another kind or too old."""
    try:
        head, body, mark = (token or "").split(".")
        good = hmac.compare_digest(_raw(mark), hmac.new(secret.encode(), f"{head}.{body}".encode(), hashlib.sha256).digest())
        claims = json.loads(_raw(body))
        if good and json.loads(_raw(head)).get("alg") == "HS256" and claims.get("type") == KIND and claims["exp"] > now:
            return claims.get("sub")
    except (ValueError, KeyError, TypeError, AttributeError):
        pass
    return None


def token_for(user: Column, now: Column, secret: str, days: int = DAYS) -> Column:
    @F.pandas_udf("string")
    def make(users: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else signed(u, int(t), secret, days) for u, t in zip(users, times, strict=True)], dtype=object)

    return make(user.cast("string"), now.cast("long"))


def subject_of(token: Column, now: Column, secret: str) -> Column:
    @F.pandas_udf("string")
    def read(tokens: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([subject(t, int(n), secret) for t, n in zip(tokens, times, strict=True)], dtype=object)

    return read(token.cast("string"), now.cast("long"))
