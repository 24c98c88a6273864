"""The engine: SQL text to lazy DataFrames over external and managed tables, with snapshot transactions."""

from __future__ import annotations

import copy
import uuid
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import errors as E
from tessera.functions.lineage import cut_lineage
from tessera.plans import ast as A
from tessera.plans.lower import Lowering, Options, Relation, Scope
from tessera.plans.parser import parse
from tessera.sources.catalog import ROW_ID, SEQ, SPARK_TYPES, ColumnDef, Part, Table
from tessera.sources.log import CommitExists, CommitLog, delete

#: Rows of a statement that are kept as values in the commit; more become a Parquet segment. A table whose parts hold
#: more than INLINE_TOTAL such rows together is compacted.
INLINE_ROWS, INLINE_TOTAL = 1000, 20_000


@dataclass
class _Transaction:
    number: int
    version: int  # the snapshot
    parts: dict[str, list[Part]] = field(default_factory=dict)


@dataclass
class VacuumConfig:
    enabled: bool = True
    transactions: int = 1000
    chain_length: int = 10
    hidden_share: float = 0.1  # of a table's row versions; fewer aren't worth a rewrite


class Session:
    """A line of statements with transactions of its own. ``Engine.execute`` uses one; others may run beside it."""

    def __init__(self, engine: Engine):
        self.engine, self.stack = engine, []

    def execute(self, sql: str) -> DataFrame | None:
        """The result of a statement, lazily for SELECT."""
        return self.engine._run(self, parse(sql))


class Engine:
    """``root``: folder (any Hadoop path) of the managed tables; without one they live as long as the engine.

    Options: validation (strict, warnings, disabled; for INSERT, UPDATE, DELETE), max_embeddings_per_row, auto_save
    (compact and checkpoint the log on close), and those of ``plans.lower.Options``.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, validation: str = "strict", max_embeddings_per_row: int = 10, auto_save: bool = False, **options):
        self.spark, self.validation, self.auto_save = spark, validation, auto_save
        self.max_embeddings_per_row, self.options, self.vacuum_config = max_embeddings_per_row, Options(**options), VacuumConfig()
        spark.conf.set("spark.sql.caseSensitive", "true")
        self.external: dict[str, tuple[str, Relation]] = {}
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, tuple[str, str]] = {}  # name: table, column key
        self.version = self.seq = self.numbers = self.since_vacuum = 0
        self.active: list[_Transaction] = []
        self.streams: dict[str, int] = {}  # the last batch of each stream
        self.main = Session(self)
        self.log = CommitLog(spark, root) if root else None
        self.recovered = self.recover() if root else 0

    # -- life
    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.auto_save and self.log:
            self._checkpoint()
        for view, _ in self.external.values():
            self.spark.catalog.dropTempView(view)
        self.external.clear()

    def session(self) -> Session:
        return Session(self)

    def execute(self, sql: str) -> DataFrame | None:
        return self.main.execute(sql)

    def register(self, name: str, df: DataFrame) -> None:
        """An external table: a DataFrame, read only."""
        view = f"_external_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        self.external[name] = (view, Relation(view, tuple((f.name, *_kind_of(f)) for f in df.schema.fields)))

    def register_parquet(self, sf_dir: str, *names: str) -> Engine:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{sf_dir}/{n}.parquet"))
        return self

    # -- log
    def recover(self) -> int:
        """Replay the log; returns the number of committed transactions found after its checkpoint."""
        state, version, commits = self.log.replay()
        self.tables, self.indexes, self.streams, self.seq = {}, {}, {}, 0
        if state:
            self.streams = dict(state.get("streams", {}))
            self.tables = {t["name"]: Table.of(t) for t in state["tables"]}
            self.indexes, self.seq = {k: tuple(v) for k, v in state["indexes"].items()}, state["seq"]
        self.version = version
        for body in commits:
            self._replay(body)
        self.log.truncate(self.version)
        return sum(any(a["do"] == "part" for a in b["actions"]) for b in commits)

    def _replay(self, body: dict) -> None:
        self.version += 1
        for action in body["actions"]:
            self._apply(action)

    def refresh(self) -> int:
        """Take over the commits that other engines have published on the same root; returns their number."""
        before = self.version
        if self.log and self.log.last_checkpoint() > self.version:  # the commits between are gone from the log
            if self.active:
                raise E.SerializationFailure("another engine has compacted the log beneath a running transaction")
            state, version, commits = self.log.replay()
            self.tables, self.indexes = {t["name"]: Table.of(t) for t in state["tables"]}, {k: tuple(v) for k, v in state["indexes"].items()}
            self.streams, self.seq, self.version = dict(state.get("streams", {})), state["seq"], version
            for body in commits:
                self._replay(body)
        while self.log and (body := self.log.read(self.version + 1)) is not None:
            self._replay(body)
        return self.version - before

    def _meet(self, actions: list[dict]) -> None:
        """Another engine was first: take its commits over, and see that these actions still hold after them."""
        before, lost = self.version, E.SerializationFailure("another engine has published a commit that this one doesn't fit")
        if not self.refresh():
            raise E.SerializationFailure("another engine is writing a commit")
        for a in actions:
            table = self.tables.get(a.get("table"))
            if a["do"] == "stream":
                if self.streams.get(a["id"], -1) >= a["batch"]:
                    raise lost
                continue
            if a["do"] != "part" or table is None:
                raise lost
            part, later = a["part"], [p for p in table.parts if p.version > before]
            if part.kind == "insert":
                if part.rows is None and any(p.kind == "insert" for p in later):
                    raise lost  # its row ids are written already
                for r in part.rows or []:
                    r[ROW_ID], table.next_row = table.next_row, table.next_row + 1
                a["next_row"] = max(a["next_row"], table.next_row)
            else:
                changed = [p for p in later if p.kind != "insert"]
                mine = table._frame(self.spark, [part], ids_only=True)
                if changed and not mine.join(table._frame(self.spark, changed, ids_only=True), ROW_ID, "left_semi").isEmpty():
                    raise lost
            part.seq = self._next_seq()

    def _publish(self, actions: list[dict]) -> None:
        """One commit: in the log first, then in memory. Where another engine was first, after its commits, or
        SerializationFailure if the two don't fit."""
        while self.log:
            try:
                self.log.append(self.version + 1, {"actions": [{**a, "part": a["part"].plain()} if a["do"] == "part" else a for a in actions]})
                break
            except CommitExists:
                self._meet(actions)
        self.version += 1
        for a in actions:
            self._apply(a)

    def _apply(self, a: dict) -> None:
        do, table = a["do"], self.tables.get(a.get("table"))
        if do == "create":
            self.tables[a["table"]] = new = Table(a["table"], [])
            for name, kind, dim in a["columns"]:
                new.add(name, kind, dim)
        elif do == "drop":
            del self.tables[a["table"]]
            self.indexes = {k: v for k, v in self.indexes.items() if v[0] != a["table"]}
        elif do == "add":
            table.add(a["name"], a["kind"], a["dim"])
        elif do == "remove":
            key = table.column(a["name"]).key
            table.columns = [c for c in table.columns if c.key != key]
            self.indexes = {k: v for k, v in self.indexes.items() if v != (a["table"], key)}
        elif do == "rename":
            table.column(a["name"]).name = a["to"]
        elif do == "index":
            self.indexes[a["name"]] = (a["table"], a["key"])
        elif do == "unindex":
            del self.indexes[a["name"]]
        elif do == "stream":
            self.streams[a["id"]] = a["batch"]
        elif do == "part":
            part = Part(**a["part"]) if isinstance(a["part"], dict) else a["part"]
            part.version = self.version
            table.parts.append(part)
            table.next_row = max(table.next_row, a["next_row"])
            self.seq = max(self.seq, part.seq)
        elif do == "compact":
            part = Part(**a["part"]) if isinstance(a["part"], dict) else a["part"]
            part.version = self.version
            table.parts = [part] if part.count else []

    def _checkpoint(self) -> None:
        self.log.checkpoint(self.version, {"tables": [t.plain() for t in self.tables.values()], "indexes": self.indexes, "seq": self.seq, "streams": self.streams})
        named = {p.path for t in self.tables.values() for p in t.parts if p.path}
        for path in self.log.segments():  # of vacuumed parts and of commits that never were
            if path not in named and not self.active:
                self.log.delete(path)

    def save(self, path: str) -> None:
        """A copy of all managed tables under ``path``, as of the last commit."""
        target = CommitLog(self.spark, path)
        if target._files():
            target.truncate(-1)
        state = []
        for t in self.tables.values():
            plain = copy.deepcopy(t.plain())
            live = t.live(self.spark, t.parts)
            part = self._part(live, "insert", self.seq, f"{target.root}/{t.name}")
            part.version = 1
            state.append({**plain, "parts": [part.plain()] if part.count else []})
        target.checkpoint(1, {"tables": state, "indexes": self.indexes, "seq": self.seq})

    @staticmethod
    def load(spark: SparkSession, path: str, **options) -> Engine:
        """An engine on the tables under ``path``; a missing folder is an empty database."""
        return Engine(spark, path, **options)

    # -- tables
    def _need(self, name: str) -> Table:
        if name in self.tables:
            return self.tables[name]
        if name in self.external:
            raise E.UnsupportedFeature(f"'{name}' is an external table: read only")
        raise E.TableNotFound(f"no table '{name}'{E.did_you_mean(name, [*self.tables, *self.external])}")

    def _visible(self, session: Session, table: Table) -> list[Part]:
        """Published parts of the session's snapshot and its own ones."""
        if not session.stack:
            return table.parts
        now = session.stack[-1]
        own = [p for t in session.stack for p in t.parts.get(table.name, [])]
        return [p for p in table.parts if p.version <= now.version] + own

    def table(self, name: str, session: Session | None = None) -> DataFrame:
        """The rows of a table; managed ones with their row id as ``_row_id``."""
        if name in self.external:
            return self.spark.table(self.external[name][0])
        table = self._need(name)
        return table.named(table.live(self.spark, self._visible(session or self.main, table)))

    def _lookup(self, session: Session, views: dict[str, Relation]):
        def find(name: str) -> Relation:
            if name not in views:
                if name in self.external:
                    views[name] = self.external[name][1]
                else:
                    table = self._need(name)
                    view = f"_managed_{uuid.uuid4().hex}"
                    self.table(name, session).createOrReplaceTempView(view)
                    views[name] = Relation(view, tuple((c.name, c.kind, c.dim) for c in table.columns), True)
            return views[name]

        return find

    # -- statements
    def _run(self, session: Session, s) -> DataFrame | None:
        if isinstance(s, A.Select):
            return self._select(session, s)
        rule = {
            A.Insert: self._insert, A.Update: self._update, A.Delete: self._delete, A.Begin: self._begin, A.Commit: self._commit,
            A.Rollback: self._rollback, A.Vacuum: self._vacuum,
        }.get(type(s))
        return rule(session, s) if rule else self._define(session, s)

    def _select(self, session: Session, s: A.Select) -> DataFrame:
        views: dict[str, Relation] = {}
        lowering = Lowering(self._lookup(session, views), self.options)
        try:
            sql = lowering.query(s)
            self._single_rows(lowering)
            return self.spark.sql(sql)
        finally:
            for r in views.values():
                if r.managed:
                    self.spark.catalog.dropTempView(r.view)

    def _single_rows(self, lowering: Lowering) -> None:
        """Raise where a scalar subquery has several rows; those that have one by their form aren't run."""
        for sql in lowering.scalars:
            if self.spark.sql(sql).limit(2).count() > 1:
                raise E.SubqueryReturnedMultipleRows("a scalar subquery has several rows, SCALAR_SUBQUERY_TOO_MANY_ROWS in Spark (hint: an aggregate, LIMIT 1 or IN)")

    def _one(self, **values) -> DataFrame:
        kinds = {int: "bigint", str: "string"}
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in values.items()))

    def _define(self, session: Session, s) -> DataFrame:
        """DDL: its own commit at once, whatever transaction runs."""
        name = getattr(s, "table", None) or (self.indexes.get(s.name, (None,))[0] if isinstance(s, A.DropIndex) else None)
        if any(name in t.parts for t in self.active):
            raise E.UnsupportedFeature(f"a transaction has written to '{name}'; end it before changing the table")
        do = None
        if isinstance(s, A.CreateTable):
            if s.table in self.tables or s.table in self.external:
                if s.if_not_exists:
                    return self._one(status=f"Table '{s.table}' already exists")
                raise E.TableAlreadyExists(s.table)
            names = [c.name for c in s.columns]
            if len(set(names)) < len(names):
                raise E.InvalidSyntax("a column is declared twice")
            self._check_embeddings([c.kind for c in s.columns])
            do = {"do": "create", "table": s.table, "columns": [(c.name, c.kind, c.dim) for c in s.columns]}
        elif isinstance(s, A.DropTable):
            if s.table not in self.tables and s.if_exists:
                return self._one(status=f"Table '{s.table}' does not exist")
            self._need(s.table)
            do = {"do": "drop", "table": s.table}
        elif isinstance(s, A.AddColumn):
            table = self._need(s.table)
            if table.column(s.column.name):
                raise E.InvalidSyntax(f"'{s.column.name}' exists already")
            self._check_embeddings([c.kind for c in table.columns] + [s.column.kind])
            do = {"do": "add", "table": s.table, "name": s.column.name, "kind": s.column.kind, "dim": s.column.dim}
        elif isinstance(s, (A.DropColumn, A.RenameColumn)):
            table = self._need(s.table)
            old = s.column if isinstance(s, A.DropColumn) else s.old
            self._need_column(table, old)
            do = {"do": "remove", "table": s.table, "name": old}
            if isinstance(s, A.RenameColumn):
                if table.column(s.new):
                    raise E.InvalidSyntax(f"'{s.new}' exists already")
                do = {"do": "rename", "table": s.table, "name": old, "to": s.new}
        elif isinstance(s, A.CreateIndex):
            table = self._need(s.table)
            if s.name in self.indexes:
                raise E.IndexAlreadyExists(s.name)
            do = {"do": "index", "name": s.name, "table": s.table, "key": self._need_column(table, s.column).key}
        elif isinstance(s, A.DropIndex):
            if s.name not in self.indexes:
                raise E.IndexNotFound(f"{s.name}{E.did_you_mean(s.name, list(self.indexes))}")
            do = {"do": "unindex", "name": s.name}
        self._publish([do])
        verb = {"create": "created", "drop": "dropped", "add": "altered", "remove": "altered", "rename": "altered", "index": "created", "unindex": "dropped"}[do["do"]]
        what = f"Index '{s.name}'" if "index" in do["do"] else f"Table '{s.table}'"
        return self._one(status=f"{what} {verb}")

    def _check_embeddings(self, kinds: list[str]) -> None:
        if kinds.count("embedding") > self.max_embeddings_per_row:
            raise E.TooManyEmbeddings(f"more than {self.max_embeddings_per_row} embedding columns")

    @staticmethod
    def _need_column(table: Table, name: str) -> ColumnDef:
        found = table.column(name)
        if not found:
            raise E.ColumnNotFound(f"no column '{name}' in '{table.name}'{E.did_you_mean(name, [c.name for c in table.columns])}")
        return found

    # -- validation of DML
    def _complain(self, error: E.EngineError) -> None:
        if self.validation == "strict":
            raise error
        if self.validation == "warnings":
            warnings.warn(f"{type(error).__name__}: {error}", stacklevel=4)

    def _coerced(self, c: ColumnDef, value):
        """``value`` for a column; types are static, so what doesn't fit is an error in every mode."""
        if value is None:
            return None
        fits = {"int": int, "float": (int, float), "text": str, "bool": bool, "embedding": tuple}[c.kind]
        if not isinstance(value, fits) or (isinstance(value, bool) and c.kind != "bool"):
            raise E.TypeMismatch(f"'{c.name}' is {c.kind}, not {value!r}")
        if c.kind == "embedding":
            if len(value) != c.dim:
                raise E.ValidationFailed(f"'{c.name}' has {c.dim} dimensions, the value has {len(value)} (hint: give exactly {c.dim} numbers)")
            return [float(x) for x in value]
        return float(value) if c.kind == "float" else value

    def _where(self, session: Session, table: Table, where) -> DataFrame:
        """Live rows that match, by column keys."""
        rows = table.live(self.spark, self._visible(session, table))
        if where is None:
            return rows
        views: dict[str, Relation] = {}
        view = f"_rows_{uuid.uuid4().hex}"
        lookup = self._lookup(session, views)
        relation = Relation(view, tuple((c.name, c.kind, c.dim) for c in table.columns), True)
        scope = Scope()
        scope.add(table.name, relation)
        try:
            table.named(rows).createOrReplaceTempView(view)
            if any(isinstance(n, A.Aggregate) for n in A.walk(where)):
                raise E.AggregateInWhere("aggregates belong in HAVING")
            lowering = Lowering(lookup, self.options)
            condition = lowering.condition(where, scope)
            self._single_rows(lowering)
            matched = self.spark.sql(f"SELECT * FROM `{view}` AS `{table.name}` WHERE {condition}")
        finally:
            for v in [view, *(r.view for r in views.values() if r.managed)]:
                self.spark.catalog.dropTempView(v)
        return matched.select(ROW_ID, *[F.col(f"`{c.name}`").alias(c.key) for c in table.columns])

    # -- DML
    def _part(self, rows: DataFrame, kind: str, seq: int, folder: str | None) -> Part:
        """The rows as a part: a segment of ``folder`` or a checkpointed frame, or values if they are few. The source
        runs once: what is counted and kept is what was written."""
        path = f"{folder}/{uuid.uuid4().hex}" if folder is not None else None
        if path:
            rows.write.parquet(path)
            frame = self.spark.read.schema(rows.schema).parquet(path)
        else:
            frame = cut_lineage(rows)
        count = frame.count()
        if count > INLINE_ROWS:
            return Part(kind, seq, count, path=path) if path else Part(kind, seq, count, frame=frame)
        held = [r.asDict() for r in frame.collect()]
        if path:
            delete(self.spark, path)
        return Part(kind, seq, count, held)

    def _folder(self, table: Table) -> str | None:
        return f"{self.log.root}/{table.name}" if self.log else None

    def _write(self, session: Session, table: Table, part: Part, more: tuple[dict, ...] = ()) -> None:
        """Into the running transaction, or as a commit of its own (with ``more`` actions)."""
        if session.stack:
            session.stack[-1].parts.setdefault(table.name, []).append(part)
            return
        self._publish([{"do": "part", "table": table.name, "part": part, "next_row": table.next_row}, *more])
        self._after_commit(table)

    def _next_seq(self) -> int:
        self.seq += 1
        return self.seq

    def _insert(self, session: Session, s: A.Insert) -> DataFrame:
        table = self._need(s.table)
        names = list(s.columns) if s.columns else [c.name for c in table.columns]
        if len(names) != len(s.values):
            self._complain(E.ValidationFailed(f"{len(names)} columns and {len(s.values)} values"))
        if len(set(names)) < len(names):
            self._complain(E.ValidationFailed("a column is given twice"))
        row = {ROW_ID: table.next_row}
        for name, value in zip(names, s.values):
            c = table.column(name)
            if c is None:
                self._complain(E.ColumnNotFound(f"no column '{name}' in '{table.name}'{E.did_you_mean(name, [x.name for x in table.columns])}"))
                continue
            row[c.key] = self._coerced(c, value.value)
        table.next_row += 1
        self._write(session, table, Part("insert", self._next_seq(), 1, [row]))
        return self._one(row_id=row[ROW_ID])

    def insert_df(self, name: str, df: DataFrame, session: Session | None = None, batch: tuple[str, int] | None = None) -> int:
        """Append the rows of ``df``, matched by column name; returns their number. One pass, no global sort: row ids
        are unique, ascending in a partition, and not consecutive. ``batch``: a stream's name and the number of its
        batch, which the same commit records; a batch that is recorded already is left out."""
        table, session = self._need(name), session or self.main
        if batch:
            if session.stack:
                raise E.UnsupportedFeature("a stream's batch is a commit of its own")
            if self.streams.get(batch[0], -1) >= batch[1]:
                return 0
        unknown = [c for c in df.columns if not table.column(c)]
        if unknown:
            raise E.ColumnNotFound(f"no column '{unknown[0]}' in '{name}'{E.did_you_mean(unknown[0], [c.name for c in table.columns])}")
        columns = []
        for c in table.columns:
            value = F.col(f"`{c.name}`").cast(SPARK_TYPES[c.kind]) if c.name in df.columns else F.lit(None).cast(SPARK_TYPES[c.kind])
            if c.kind == "embedding" and c.name in df.columns:
                value = F.when(value.isNull() | ((F.size(value) == c.dim) & ~F.exists(value, lambda x: x.isNull())), value).otherwise(F.raise_error(F.lit(f"'{c.name}' has {c.dim} dimensions, none of them null")).cast(SPARK_TYPES[c.kind]))
            columns.append(value.alias(c.key))
        rows = df.select((F.monotonically_increasing_id() + table.next_row).alias(ROW_ID), *columns)
        part = self._part(rows, "insert", self._next_seq(), self._folder(table))
        if part.rows is not None:
            for i, r in enumerate(part.rows):
                r[ROW_ID] = table.next_row + i
            table.next_row += part.count
        elif part.count:
            stored = part.frame if part.frame is not None else self.spark.read.parquet(part.path)
            table.next_row = stored.agg(F.max(ROW_ID)).first()[0] + 1
        self._write(session, table, part, ({"do": "stream", "id": batch[0], "batch": batch[1]},) if batch else ())
        return part.count

    def _update(self, session: Session, s: A.Update) -> DataFrame:
        table, given = self._need(s.table), {}
        for name, value in s.assignments:
            c = table.column(name)
            if c is None:
                self._complain(E.ColumnNotFound(f"no column '{name}' in '{table.name}'{E.did_you_mean(name, [x.name for x in table.columns])}"))
                continue
            if c.key in given:
                self._complain(E.ValidationFailed(f"'{name}' is set twice"))
            given[c.key] = (c, self._coerced(c, value.value))
        rows = self._where(session, table, s.where)
        for key, (c, value) in given.items():
            literal = F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value)
            rows = rows.withColumn(key, literal.cast(SPARK_TYPES[c.kind]))
        return self._one(updated=self._change(session, table, rows, "update"))

    def _delete(self, session: Session, s: A.Delete) -> DataFrame:
        table = self._need(s.table)
        return self._one(deleted=self._change(session, table, self._where(session, table, s.where).select(ROW_ID), "delete"))

    def _change(self, session: Session, table: Table, rows: DataFrame, kind: str) -> int:
        part = self._part(rows, kind, self._next_seq(), self._folder(table))
        if part.count:
            self._conflicts(session, table, part)
            self._write(session, table, part)
        return part.count

    def _conflicts(self, session: Session, table: Table, part: Part) -> None:
        """The first writer of a row wins: none of these rows may be changed by a transaction that runs beside this one
        or that committed after its snapshot."""
        others = [p for t in self.active if t not in session.stack for p in t.parts.get(table.name, [])]
        if session.stack:
            others += [p for p in table.parts if p.version > session.stack[-1].version]
        others = [p for p in others if p.kind != "insert"]
        if not others:
            return
        mine = table._frame(self.spark, [part], ids_only=True)
        if not mine.join(table._frame(self.spark, others, ids_only=True), ROW_ID, "left_semi").isEmpty():
            raise E.SerializationFailure(f"a row of '{table.name}' was changed by another transaction")

    # -- transactions
    def _begin(self, session: Session, _) -> DataFrame:
        self.numbers += 1
        now = _Transaction(self.numbers, session.stack[-1].version if session.stack else self.version)
        session.stack.append(now)
        self.active.append(now)
        return self._one(status=f"Transaction {now.number} started")

    def _end(self, session: Session) -> _Transaction:
        if not session.stack:
            raise E.NoActiveTransaction("no transaction is running")
        now = session.stack.pop()
        self.active.remove(now)
        return now

    def _commit(self, session: Session, _) -> DataFrame:
        now = self._end(session)
        if session.stack:  # a nested one becomes part of the outer one
            for name, parts in now.parts.items():
                session.stack[-1].parts.setdefault(name, []).extend(parts)
        elif now.parts:
            self._publish([{"do": "part", "table": n, "part": p, "next_row": self.tables[n].next_row} for n, parts in now.parts.items() for p in parts])
        return self._one(status=f"Transaction {now.number} committed")

    def _rollback(self, session: Session, _) -> DataFrame:
        now = self._end(session)
        for parts in now.parts.values():
            for p in parts:
                if p.path:
                    self.log.delete(p.path)
        return self._one(status=f"Transaction {now.number} rolled back")

    # -- maintenance
    def _after_commit(self, table: Table) -> None:
        self.since_vacuum += 1
        c = self.vacuum_config
        if not c.enabled or self.active:
            return
        hidden = sum(p.count for p in table.parts if p.kind != "insert")
        stored = sum(p.count for p in table.parts if p.kind != "delete")
        chained = sum(p.kind == "update" for p in table.parts) > c.chain_length and hidden >= c.hidden_share * stored
        inline = sum(p.count for p in table.parts if p.rows is not None) > INLINE_TOTAL
        if self.since_vacuum >= c.transactions or chained or inline:
            for t in list(self.tables.values()) if self.since_vacuum >= c.transactions else [table]:
                self._compact(t)

    def _compact(self, table: Table) -> int:
        """Rewrite the live rows as one part; returns the number of row versions that went."""
        before = sum(p.count for p in table.parts if p.kind != "delete")
        keys = {c.key for c in table.columns}
        indexed = [k for t, k in self.indexes.values() if t == table.name and k in keys]
        live = table.live(self.spark, table.parts)
        part = self._part(live.sortWithinPartitions(*indexed) if indexed else live, "insert", self._next_seq(), self._folder(table))
        self._publish([{"do": "compact", "table": table.name, "part": part}] if not self.log else [{"do": "compact", "table": table.name, "part": part.plain()}])
        if self.log and not self.active:
            self._checkpoint()
        self.since_vacuum = 0
        return before - part.count

    def _vacuum(self, session: Session, s: A.Vacuum) -> DataFrame:
        if self.active:
            raise E.UnsupportedFeature("VACUUM waits until no transaction runs")
        out = []
        for t in [self._need(s.table)] if s.table else list(self.tables.values()):
            removed = self._compact(t)
            n = sum(p.count for p in t.parts)
            out.append((t.name, removed, n, n, min(n, 1)))
        return self.spark.createDataFrame(out, "table_name string, versions_removed bigint, total_chains bigint, total_versions bigint, max_chain_length bigint")

    def table_stats(self, name: str) -> DataFrame:
        """Row versions and chains of a table as they are stored."""
        t = self._need(name)
        each = t.versions(self.spark, t.parts).groupBy(ROW_ID).count()
        return each.agg(F.count(F.lit(1)).alias("total_chains"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_versions"), F.coalesce(F.max("count"), F.lit(0)).alias("max_chain_length"))

    # -- lookups of the programmatic interface
    def index_query(self, index: str, value) -> DataFrame:
        """_row_id of the rows whose indexed column has ``value``."""
        return self._index(index).filter(F.col("v") == F.lit(value)).select(ROW_ID)

    def index_range(self, index: str, low=None, high=None) -> DataFrame:
        """_row_id, inclusive bounds, in order of the value."""
        rows = self._index(index)
        rows = rows if low is None else rows.filter(F.col("v") >= F.lit(low))
        rows = rows if high is None else rows.filter(F.col("v") <= F.lit(high))
        return rows.orderBy("v", ROW_ID).select(ROW_ID)

    def indexes_of(self, table: str) -> list[str]:
        return sorted(k for k, (t, _) in self.indexes.items() if t == self._need(table).name)

    def index_for(self, table: str, column: str) -> str | None:
        """The first index on a column, by name."""
        key = self._need_column(self._need(table), column).key
        return next((k for k in self.indexes_of(table) if self.indexes[k][1] == key), None)

    def checkpoint(self) -> None:
        """Write the whole state as one file of the log and delete what it replaces."""
        if self.log:
            self._checkpoint()

    def _index(self, index: str) -> DataFrame:
        if index not in self.indexes:
            raise E.IndexNotFound(index)
        name, key = self.indexes[index]
        t = self.tables[name]
        return t.live(self.spark, self._visible(self.main, t)).select(ROW_ID, F.col(key).alias("v"))

    def vectors(self, table: str, column: str):
        """Vector search over a column of a table."""
        from tessera.operators.vector import VectorSet

        df = self.table(table)
        if column not in df.columns:
            raise E.ColumnNotFound(f"no column '{column}' in '{table}'{E.did_you_mean(column, df.columns)}")
        return VectorSet(df.withColumnRenamed(ROW_ID, "id") if ROW_ID in df.columns and "id" not in df.columns else df, "id" if "id" in df.columns or ROW_ID in df.columns else df.columns[0], column)

    def rebuild_vectors(self) -> int:
        """Search is exact and needs no index; returns the number of stored embeddings."""
        total = 0
        for t in self.tables.values():
            for c in t.columns:
                if c.kind == "embedding":
                    total += t.live(self.spark, t.parts).filter(F.col(c.key).isNotNull()).count()
        return total


def _kind_of(f: T.StructField) -> tuple[str, int | None]:
    kind, dim = f.dataType, f.metadata.get("dim")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int", None
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float", None
    if isinstance(kind, T.StringType):
        return "text", None
    if isinstance(kind, T.BooleanType):
        return "bool", None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return "embedding", dim
    return "other", None


__all__ = ["Engine", "Session", "VacuumConfig", "SEQ"]
