"""The calls of a log or of a federation of logs, each checked against its user's roles."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from tidelog.functions.text import split_list
from tidelog.functions.timing import parse_duration
from tidelog.operators import access
from tidelog.plans.query import LogQuery
from tidelog.sources.federation import Federation
from tidelog.sources.frames import from_internal, to_internal
from tidelog.sources.store import LogStore


class Refused(PermissionError):
    """The user may not do this."""


class Service:
    """Ten calls on one store or on a federation; user is (name, password).

    A federation takes no entries and no chunks, a single store no users: what
    the other kind does, each refuses with ``TypeError``.
    """

    def __init__(self, spark: SparkSession, logs: LogStore | Federation, users: DataFrame | None = None, limits: dict[str, int] | int = 0):
        self.spark, self.logs, self.limits, self.last_transfer_id = spark, logs, limits, 0
        self.users = users if users is not None else access.users(spark, [(access.ADMIN, ["admin"], access.ADMIN), (access.ANONYMOUS, [], "")])

    def _check(self, user: tuple[str, str], action: str) -> None:
        asked = self.spark.createDataFrame([(*user, action)], "user string, password string, action string")
        if not access.decide(self.spark, asked, self.users).first()["allowed"]:
            raise Refused(f"{user[0]} may not {action}")

    def _store(self) -> LogStore:
        if not isinstance(self.logs, LogStore):
            raise TypeError("this is a federation; ask one of its logs")
        return self.logs

    def write(self, user: tuple[str, str], entries: DataFrame, arrival: str | None = None) -> None:
        self._check(user, "write")
        self._store().append(entries, arrival)

    def read(self, user: tuple[str, str], *queries: LogQuery, sort: bool = True) -> DataFrame:
        self._check(user, "read")
        return self.logs.read(*queries, sort=sort)

    def internal_read(self, user: tuple[str, str], *queries: LogQuery) -> DataFrame:
        """As logs send entries to each other."""
        self._check(user, "iread")
        return to_internal(self.logs.read(*queries))

    def truncate(self, user: tuple[str, str], limit: str | int, sources: str = "", now: int | None = None) -> int:
        """Drop what is older than now and a duration (``-24h``, or nanoseconds), once for each of the comma-separated patterns; the time it means.

        A duration of zero is no limit and is rejected.
        """
        self._check(user, "truncate")
        distance = parse_duration(limit) if isinstance(limit, str) else limit
        if not distance:
            raise ValueError("the limit is not given")
        at = (time.time_ns() if now is None else now) + distance
        for source in split_list(sources) or [""]:
            self.logs.truncate(at, source)
        return at

    def transfer(self, user: tuple[str, str], ident: int, to: Service, amount: int, as_user: tuple[str, str], now: int | None = None) -> list[tuple[str, int, int]]:
        """Move chunks to another log, as one of its users, until the amount is reached; then the transfer is this log's last."""
        self._check(user, "transfer")
        to._check(as_user, "accept")
        moved = self._store().transfer(to._store(), amount, now)
        self.last_transfer_id = ident
        return moved

    def accept(self, user: tuple[str, str], source: str, hour: int, entries: DataFrame) -> bool:
        """Merge a chunk in the form of ``internal_read``; whether that went well."""
        self._check(user, "accept")
        self._store().accept(source, hour, from_internal(entries))
        return True

    def stat(self, user: tuple[str, str]) -> DataFrame:
        """addr, size, limit: of a store one row without address, of a federation a row per log."""
        self._check(user, "stat")
        if isinstance(self.logs, LogStore):
            limit = self.limits if isinstance(self.limits, int) else 0
            return Federation({"": self.logs}).stats({"": limit})
        return self.logs.stats(self.limits if isinstance(self.limits, dict) else {a: self.limits for a in self.logs.stores})

    def heartbeat(self, addr: str, now: int | None = None) -> DataFrame:
        """ts, addr, size, limit, last_transfer_id of a single log."""
        row = Federation({addr: self._store()}).stats({addr: self.limits if isinstance(self.limits, int) else 0}).first()
        beat = (time.time_ns() if now is None else now, addr, row["size"], row["limit"], self.last_transfer_id)
        return self.spark.createDataFrame([beat], "ts long, addr string, size long, limit long, last_transfer_id long")

    def user(self, user: tuple[str, str], name: str, roles: list[str] | None = None, password: str | None = None, delete: bool = False) -> None:
        """Set a user's roles, and the password if one is given, or delete the user."""
        self._check(user, "user")
        if isinstance(self.logs, LogStore):
            raise TypeError("a single log keeps no users")
        if delete:
            self.users = access.delete_user(self.users, name)
            return
        self.users = access.set_roles(self.users, name, roles or [])
        if password is not None:
            self.users = access.set_password(self.users, name, password)

    def password(self, user: tuple[str, str], new: str) -> None:
        self._check(user, "pass")
        if isinstance(self.logs, LogStore):
            raise TypeError("a single log keeps no users")
        self.users = access.set_password(self.users, user[0], new)
