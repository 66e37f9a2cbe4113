"""A preparation chain: fitted step by step on train rows, applied lazily anywhere.

Order of work: impute when the chain has an I step (wherever it stands), then the other
steps in their order. Constant columns are dropped before E, N and FT and at the end; the
columns kept at each point are part of the fitted chain and are replayed on new data.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from winnow.operators.encode import fit_encoder
from winnow.operators.features import fit_features
from winnow.operators.impute import fit_imputer
from winnow.operators.outlier import fit_outliers
from winnow.operators.scale import MONOTONE, fit_scaler
from winnow.operators.select import by_variance, column_stats, keep_columns, select_features
from winnow.roles import ROLES, Roles, lay_out

STEPS = ("I", "O", "E", "N", "FT", "FS")
RANKED = {"median", "iqr", "robust", "quantile", "kbins"}


@dataclass(frozen=True)
class Step:
    step: str
    method: str | None
    params: tuple = ()


def steps_of(order: list[str], ops: list[str | None]) -> list[Step]:
    """Pair step names with operators and attach the fixed parameters of each step."""
    if len(order) != len(ops):
        raise ValueError(f"{len(order)} steps but {len(ops)} operators")
    # Parameters that go with a step.
    extra = {
        "O": (("threshold", 3),),
        "FT": (("n_components", 2),),
        "FS": (("var_threshold", 0), ("pearson_threshold", 0.1)),
    }
    out = []
    for s, m in zip(order, ops):
        if s not in STEPS:
            raise ValueError(f"unknown step: {s}")
        out.append(Step(s, None if m in (None, "none") else m, extra.get(s, ())))
    return out


class Keep:
    """Columns kept; ``stats`` are the statistics that the choice was made by."""

    def __init__(self, columns: list[str], roles: Roles, stats: dict | None = None):
        self.columns, self.roles, self.stats = columns, roles, stats

    def apply(self, df: DataFrame) -> DataFrame:
        return keep_columns(df, self.columns, self.roles)


class SharedPrefixes:
    """Fitted prefixes of many chains over one split: the parts, and both tables with the parts
    applied. Chains that start alike, also at the same time, fit and apply the start once: the
    first to come works, the others wait for its result (or its failure). With ``keep`` every
    prepared train table is cached until ``close``; meant for samples of bounded size."""

    def __init__(self, train: DataFrame, test: DataFrame, roles: Roles = ROLES, keep: bool = False):
        self.train, self.test = lay_out(train, roles), lay_out(test, roles)
        self.keep, self._kept = keep, []
        self._lock = Lock()
        self._steps: dict[tuple, Future] = {}

    def after(self, key: tuple, make: Callable) -> Future:
        with self._lock:
            step, mine = self._steps.get(key), key not in self._steps
            if mine:
                step = self._steps[key] = Future()
        if mine:
            try:
                step.set_result(make())
            except BaseException as e:  # noqa: BLE001 - handed to every chain that waits
                step.set_exception(e)
        return step

    def held(self, df: DataFrame) -> DataFrame:
        if self.keep:
            df = df.persist()
            self._kept.append(df)
        return df

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept = []

    def n_rows(self) -> int:
        return self.after(("count",), self.train.count).result()


@dataclass
class FittedChain:
    """``ready`` holds the prepared (train, test) of a chain fitted over shared prefixes."""

    parts: list = field(default_factory=list)
    roles: Roles = ROLES
    ready: tuple | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Lazy; one projection per step plus lookups, valid on a stream (but for the knn imputer)."""
        out = lay_out(df, self.roles)
        for p in self.parts:
            out = p.apply(out)
        return out


def fit_chain(
    df: DataFrame,
    steps: list[Step],
    roles: Roles = ROLES,
    explicit_selection: bool = False,
    shared: SharedPrefixes | None = None,
    keep_cached: bool = True,
) -> FittedChain:
    """Fit every step on ``df``, or on the train side of ``shared``, where chains that start the
    same way fit the shared part once."""
    chain = FittedChain(roles=roles)
    base = lay_out(df, roles) if shared is None else shared.train
    keep_cached = keep_cached and shared is None
    if keep_cached:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        given = {s.step: s.method for s in steps if s.method}
        # only rank-based fits need the row count
        n_rows = None
        if set(given.values()) & RANKED:
            n_rows = base.count() if shared is None else shared.n_rows()
        done: tuple = ()
        current, test, stats, settled = base, shared and shared.test, None, False

        def add(key, make):
            nonlocal done, current, test
            done = done + (key,)
            before, other = current, test

            def work():
                part = make(before)
                ready = part.apply(before)
                return part, shared.held(ready) if shared else ready, other and part.apply(other)

            part, current, test = work() if shared is None else shared.after(done, work).result()
            chain.parts.append(part)

        def trim():
            nonlocal stats

            def keep(d):
                found = column_stats(d, roles)
                varying = set(by_variance(d, 0.0, roles, found))
                num = set(roles.numeric(d))
                return Keep([c for c in roles.features(d) if c not in num or c in varying], roles, found)

            add("keep", keep)
            stats = chain.parts[-1].stats

        imputer = None
        if "I" in given:
            add(("I", given["I"]), lambda d: fit_imputer(d, given["I"], roles, n_rows=n_rows))
            imputer = chain.parts[-1]
        for s in steps:
            if s.step == "I" or not s.method:
                continue
            if s.step == "O":
                def mask(d, s=s):
                    refill = imputer or fit_imputer(d, "mean", roles, n_rows=n_rows)
                    return fit_outliers(d, s.method, float(dict(s.params).get("threshold", 3)), refill, roles, n_rows)

                add(("O", s.method), mask)
                settled = False
            elif s.step == "E":
                if not settled:
                    trim()
                if roles.categorical(current):
                    add(("E", s.method), lambda d, s=s: fit_encoder(d, s.method, roles))
                    settled = False
            elif s.step == "N" and roles.numeric(current):
                trim()
                add(("N", s.method), lambda d, s=s: fit_scaler(d, s.method, roles, n_rows, stats))
                # nothing can have become constant: the selection that follows would keep all
                settled = s.method in MONOTONE
            elif s.step == "FT" and roles.numeric(current):
                if not settled:
                    trim()
                k = int(dict(s.params).get("n_components", 2))
                add(("FT", s.method, k), lambda d, s=s: fit_features(d, s.method, k, roles))
                settled = False
            elif s.step == "FS" and explicit_selection:
                add(("FS", s.method), lambda d, s=s: Keep(select_features(d, s.method, roles=roles), roles))
        if not settled:
            trim()
        if shared is not None:
            chain.ready = (current, test)
        return chain
    finally:
        if keep_cached:
            base.unpersist()
