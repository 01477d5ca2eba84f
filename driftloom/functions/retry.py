"""Errors with codes and hints, and retries of driver-side calls; Spark itself retries tasks."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

R = TypeVar("R")

#: Codes with their category, whether a retry may help, and what to do.
CODES = {
    "CONFIG_INVALID": ("config", False, "check the configuration file's fields"),
    "CONNECT_FAILED": ("connection", True, "check host, port and that the database accepts connections"),
    "CONNECT_TIMEOUT": ("connection", True, "check the network path and raise the timeout"),
    "AUTH_FAILED": ("connection", False, "check user and password"),
    "NO_PRIMARY_KEY": ("schema", False, "add a primary key, ignore the table or compare it as a multiset"),
    "TABLE_UNKNOWN": ("schema", False, "name a table that both sides have and neither ignores"),
    "DUPLICATE_KEY": ("content", False, "choose a key that names one row"),
    "NULL_KEY": ("content", False, "compare without kept digests, which match nulls too"),
    "QUERY_FAILED": ("query", True, "look at the database's own message"),
    "APPLY_FAILED": ("apply", False, "nothing was applied; mend the statement and run again"),
    "BASE_CHANGED": ("apply", False, "nothing was applied; compare again and make a new pack"),
    "PACK_MISSING": ("apply", False, "name a folder that gen-pack wrote for these sides"),
    "FILE_FAILED": ("file", False, "check the path and its permissions"),
    "VERSION_UNKNOWN": ("version", False, "list versions with `version log`"),
}


class DriftError(Exception):
    """An error with a code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, (self.category, self.retryable, self.hint) = code, CODES[code]


def retry(call: Callable[[], R], attempts: int = 3, delay: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> R:
    """call's result; a retryable DriftError is tried again after a delay that doubles."""
    for n in range(attempts):
        try:
            return call()
        except DriftError as e:
            if not e.retryable or n == attempts - 1:
                raise
            sleep(min(most, delay * 2**n))
    raise AssertionError("attempts must be positive")


#: What drivers say of connections that may come up again, and of those that won't.
_AGAIN = ("connection refused", "communications link failure", "connection reset", "too many connections", "the connection attempt failed", "unable to connect", "broken pipe", "network adapter could not establish")
_LATE = ("timed out", "timeout")
_DENIED = ("access denied", "password authentication failed", "login failed", "invalid username/password", "authentication")


def connected(call: Callable[[], R]) -> R:
    """call's result; a driver's error of connecting is raised with its code, so that retry can tell which may help. Others pass as they are."""
    try:
        return call()
    except DriftError:
        raise
    except Exception as e:
        said = str(e).lower()
        for code, texts in (("AUTH_FAILED", _DENIED), ("CONNECT_FAILED", _AGAIN), ("CONNECT_TIMEOUT", _LATE)):
            if any(x in said for x in texts):
                raise DriftError(code, str(e).split("\n")[0]) from e
        raise
