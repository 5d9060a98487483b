"""Case tables behind an SQL guard; statements run as parameterised Spark SQL.

The guard is lexical first: it masks literals, then checks operations, tables, comments, stacking,
tautologies and limits. A name that follows FROM, JOIN, INTO or TABLE, or a comma in a FROM list, must be
one of the tables, however it is quoted. What passes is read by Spark's parser, which runs nothing, and
checked again on the tree (``tree_of``): every relation, in subqueries and common tables too, and every operation.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The case tables.
TABLES = {
    "incidents": "id long, incident_type string, date_approx string, location string, risk_level string, summary string, created_at timestamp",
    "suspects": "id long, incident_id long, alias_or_name string, physical_description string, status string",
    "evidences": "id long, incident_id long, item string, location_found string, evidence_type string",
    "victims": "id long, incident_id long, name_or_identity string, injury_status string, statement_summary string",
}
CHECKS = {"incidents": "incident_type IS NOT NULL AND risk_level IN ('Bajo', 'Medio', 'Alto', 'Crítico')", "suspects": "alias_or_name IS NOT NULL AND status IN ('Identificado', 'Detenido', 'En fuga', 'Desconocido')", "evidences": "item IS NOT NULL", "victims": "name_or_identity IS NOT NULL"}
# Words that are refused wherever they stand outside literals.
DANGEROUS = (
    "DROP", "DELETE", "UPDATE", "ALTER", "TRUNCATE",
    "ATTACH", "DETACH", "PRAGMA", "VACUUM", "EXEC",
    "EXECUTE", "CREATE", "REPLACE", "GRANT", "REVOKE",
    "SHUTDOWN", "XP_CMDSHELL", "LOAD_EXTENSION",
    "BENCHMARK", "SLEEP",
)
#: Own additions: MERGE writes in Spark SQL, and the others read or write files of a server.
ADDED = ("MERGE", "LOAD_FILE", "OUTFILE", "DUMPFILE", "WRITEFILE", "READFILE")
FORBIDDEN = DANGEROUS + ADDED
# Names of databases' own tables and schemas.
SYSTEM = ("sqlite_master", "sqlite_schema", "sqlite_temp_master", "sqlite_temp_schema", "sqlite_sequence", "sqlite_stat1", "sqlite_stat4", "information_schema", "pg_catalog", "sys", "mysql", "performance_schema")

_LITERAL = r"'(?:[^']|'')*'"
_TOKEN = re.compile(rf"""{_LITERAL}|"[^"]*"|`[^`]*`|\[[^\]]*\]|[A-Za-z_]\w*|\S""")
_CLAUSES = {"WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "SELECT", "VALUES", "WINDOW", "OFFSET"}
#: A test of something against itself, or of a truth, after OR or WHERE.
_TAUTOLOGY = re.compile(rf"""\b(?:OR|WHERE)\s+(?:\(\s*)*(?:TRUE\b|(\w+)\s*=\s*\1(?!\w)|({_LITERAL})\s*=\s*\2|("[^"]*")\s*=\s*\3)""", re.I)


class GuardError(ValueError):
    """A statement the guard refuses."""


@dataclass(frozen=True)
class Statement:
    """A statement with the operation and the table it claims to touch."""

    operation: str
    table: str
    sql: str
    params: dict | list | None = None


def relations(sql: str) -> list[str]:
    """The names, quotes kept, that stand where a statement names a relation."""
    found, wanted, listed = [], False, [False]
    tokens = _TOKEN.findall(sql)
    i = 0
    while i < len(tokens):
        t, word = tokens[i], tokens[i].upper()
        if t == "(":
            listed.append(wanted)  # a relation in brackets, or a subquery
        elif t == ")":
            listed = listed[:-1] or [False]
            wanted = False
        elif word in ("FROM", "JOIN", "INTO", "TABLE"):
            wanted = True
            listed[-1] = listed[-1] or word == "FROM"
        elif word in _CLAUSES:
            wanted, listed[-1] = False, False
        elif t == ",":
            wanted = listed[-1]
        elif wanted:
            name = t
            while i + 2 < len(tokens) and tokens[i + 1] == ".":
                name += "." + tokens[i + 2]
                i += 2
            found.append(name)
            wanted = False
        i += 1
    return found


def tree_of(spark: SparkSession, sql: str) -> tuple[set[str], set[str]]:
    """(operations, relations) of a statement, from Spark's unresolved plan: nothing is resolved or run.

    Operations are plan nodes by class; relations are names as written, in lower case, common tables left out where they are in scope.
    """
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise GuardError("Spark's parser doesn't read the statement") from e
    operations, relations_ = set(), set()

    def each(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    holds_plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def expressions(e, scope: frozenset[str]) -> None:
        if holds_plan.isInstance(e):
            plan(e.plan(), scope)
        for c in each(e.children()):
            expressions(c, scope)

    def plan(p, scope: frozenset[str]) -> None:
        name = p.getClass().getSimpleName()
        operations.add(name)
        if name == "UnresolvedRelation":
            parts = ".".join(each(p.multipartIdentifier())).lower()
            if parts not in scope:
                relations_.add(parts)
        if name == "UnresolvedWith":
            for pair in each(p.cteRelations()):
                plan(pair._2(), scope)
                scope = scope | {str(pair._1()).lower()}
        if name == "InsertIntoStatement":
            plan(p.table(), scope)
        for e in each(p.expressions()):
            expressions(e, scope)
        for c in each(p.children()):
            plan(c, scope)

    plan(root, frozenset())
    return operations, relations_


@dataclass(frozen=True)
class Guard:
    """What statements may do; validate returns the statement to run."""

    tables: tuple[str, ...] = tuple(TABLES)
    operations: tuple[str, ...] = ("SELECT", "INSERT")
    max_limit: int = 100
    default_limit: int = 100

    def validate(self, statement: str | Statement) -> str:
        if isinstance(statement, Statement):
            if statement.operation.upper() not in self.operations:
                raise GuardError("operation isn't allowed")
            if self._table(statement.table) not in self._known():
                raise GuardError(f"table {statement.table} isn't allowed")
            statement = statement.sql
        if not isinstance(statement, str):
            raise GuardError("a statement is a string")
        text = statement.strip()
        if not text:
            raise GuardError("empty statement")
        bare = re.sub(_LITERAL, "''", text)
        if "'" in bare.replace("''", ""):
            raise GuardError("unterminated literal")
        if bare.count('"') % 2 or bare.count("`") % 2:
            raise GuardError("unbalanced quotes")
        plain = re.sub(r'"[^"]*"', '""', bare)
        depth = 0
        for c in plain:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                break
        if depth:
            raise GuardError("unbalanced brackets")
        if any(mark in plain for mark in ("--", "/*", "*/", "#")):
            raise GuardError("comments aren't allowed")
        if ";" in plain:
            raise GuardError("one statement only, without a semicolon")
        words = re.findall(r"[A-Za-z_]\w*", plain.upper())
        if not words or words[0] not in self.operations:
            raise GuardError("operation isn't allowed")
        if hit := [w for w in words if w in FORBIDDEN]:
            raise GuardError(f"{hit[0]} isn't allowed")
        if hit := [w for w in re.findall(r"\w+", bare.lower()) if w in SYSTEM]:
            raise GuardError(f"{hit[0]} isn't allowed")
        if _TAUTOLOGY.search(text):
            raise GuardError("a condition that always holds")
        named = relations(bare)
        if words[0] == "INSERT" and (len(words) < 2 or words[1] != "INTO"):
            raise GuardError("INSERT without a table")
        if bad := [t for t in named if self._table(t) not in self._known()]:
            raise GuardError(f"table {bad[0]} isn't allowed")
        if not named:
            raise GuardError("no table")
        return self._limited(text, plain) if words[0] == "SELECT" else text

    def _known(self) -> set[str]:
        return {t.lower() for t in self.tables}

    def _table(self, name: str) -> str:
        """The bare name of a relation; a schema other than main makes it unknown."""
        parts = [p.strip().strip('"`[]').lower() for p in str(name).split(".")]
        return parts[-1] if len(parts) == 1 or len(parts) == 2 and parts[0] == "main" else str(name)

    def _limited(self, text: str, bare: str) -> str:
        for x in re.findall(r"\bLIMIT\s+([^\s,)]+)", bare, re.I):
            if re.fullmatch(r"\?|:\w+", x):
                continue
            if not re.fullmatch(r"[0-9]+", x) or not 0 < int(x) <= self.max_limit:
                raise GuardError("limit out of range")
        outer = re.search(r"\bLIMIT\s+(?:[0-9]+|:\w+|\?)(?:\s+OFFSET\s+(?:[0-9]+|:\w+|\?))?\s*$", bare, re.I)
        return text if outer else f"{text} LIMIT {self.default_limit}"


# The named questions.
TEMPLATES = {
    "high_risk": "SELECT id, incident_type, risk_level FROM incidents WHERE risk_level IN ('Alto', 'Crítico') ORDER BY id",
    "suspects_at_large": "SELECT s.alias_or_name, i.location FROM suspects s JOIN incidents i ON s.incident_id = i.id WHERE s.status = 'En fuga' ORDER BY s.id",
    "evidence_by_type": "SELECT evidence_type, COUNT(*) AS n FROM evidences GROUP BY evidence_type HAVING COUNT(*) >= 1 ORDER BY evidence_type",
    "victims_of": "SELECT name_or_identity, injury_status FROM victims WHERE incident_id = :incident ORDER BY id",
    "by_location": "SELECT id, summary FROM incidents WHERE id IN (SELECT incident_id FROM evidences WHERE item LIKE :item) ORDER BY id",
}


@dataclass
class CaseStore:
    """The four tables as DataFrames; statements pass the guard, then Spark SQL."""

    spark: SparkSession
    guard: Guard = field(default_factory=Guard)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, schema in TABLES.items():
            self.frames.setdefault(name, self.spark.createDataFrame([], schema))

    def insert(self, rows: dict[str, DataFrame]) -> None:
        """Adds rows to all tables or none: every check is made before any table changes."""
        for name, df in rows.items():
            if not df.where(f"NOT coalesce({CHECKS[name]}, false)").isEmpty():
                raise GuardError(f"{name}: a row breaks its checks")
        self.frames = {**self.frames, **{n: self.frames[n].unionByName(df) for n, df in rows.items()}}

    def _placed(self, text: str) -> str:
        """Table names outside literals, where a relation may stand, give way to the frames."""
        names = "|".join(self.frames)
        relation = rf"""\b(FROM|JOIN)(\s+\(*\s*)(?:main\s*\.\s*)?["`\[]?({names})\b["`\]]?|(,)(\s*)({names})\b(?=\s*(?:,|\)|$|\bAS\b|[A-Za-z_]))"""

        def put(m: re.Match) -> str:
            if m[0][0] in "'\"":
                return m[0]
            return f"{m[1]}{m[2]}{{{m[3].lower()}}}" if m[1] else f"{m[4]}{m[5]}{{{m[6].lower()}}}"

        # braces in literals would be taken for frames
        return re.sub(rf"""{_LITERAL}|"[^"]*"(?!\s*\.)|{relation}""", lambda m: m[0].replace("{", "{{").replace("}", "}}") if m[0][0] in "'\"" else put(m), text, flags=re.I)

    def _checked(self, statement: str | Statement) -> str:
        """The statement as it runs, once the guard and the tree of Spark's parser have passed it."""
        text = self.guard.validate(statement)
        quoted = re.sub(rf"""({_LITERAL})|"([^"]*)"|\[([^\]]*)\]""", lambda m: m[1] or (f"`{m[2] or m[3]}`" if (m[2] or m[3] or "").lower() in self.frames else m[0]), text)
        operations, named = tree_of(self.spark, quoted)
        if writes := [x for x in operations if x.endswith(("Command", "Statement")) and x != "InsertIntoStatement" or x.startswith(("Create", "Drop", "Alter", "Set", "Delete", "Update", "Merge", "UnresolvedTableValuedFunction"))]:
            raise GuardError(f"{sorted(writes)[0]} isn't allowed")
        if bad := sorted(x for x in named if x.removeprefix("main.") not in self.guard._known()):
            raise GuardError(f"table {bad[0]} isn't allowed")
        return text

    def query(self, sql: str | Statement, args: dict | list | None = None, timeout_s: float | None = None) -> DataFrame:
        """Runs one guarded SELECT; its rows, at most the guard's limit, are read at once, under the timeout if there is one."""
        if isinstance(sql, Statement) and args is None:
            args = sql.params
        text = self._placed(self._checked(sql))
        frame = self.spark.sql(text, args=args or {}, **{n: df for n, df in self.frames.items() if f"{{{n}}}" in text})
        tag = f"case-{uuid.uuid4().hex}"
        self.spark.addTag(tag)
        timer = threading.Timer(timeout_s, lambda: self.spark.interruptTag(tag)) if timeout_s is not None else None
        if timer:
            timer.start()
        try:
            return self.spark.createDataFrame(frame.collect(), frame.schema)
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(tag)

    def _inserted(self, text: str, args: dict | list | None) -> tuple[str, DataFrame]:
        """(table, its new rows) of a checked INSERT: columns that aren't named are null."""
        m = re.match(r"""\s*INSERT\s+INTO\s+(?:main\s*\.\s*)?["`\[]?(\w+)["`\]]?\s*(?:\(([^()]*)\)\s*(?=VALUES|SELECT|WITH))?""", text, re.I)
        if not m:
            raise GuardError("INSERT without a table")
        name, rest = m[1].lower(), text[m.end() :]
        schema = [tuple(c.split()) for c in TABLES[name].split(", ")]
        columns = [c.strip().strip('"`[]').lower() for c in m[2].split(",")] if m[2] else [c for c, _ in schema]
        placed = self._placed(rest)
        rows = self.spark.sql(placed, args=args or {}, **{n: df for n, df in self.frames.items() if f"{{{n}}}" in placed})
        if len(rows.columns) != len(columns) or len(set(columns)) < len(columns) or set(columns) - {c for c, _ in schema}:
            raise GuardError(f"{name}: columns don't fit")
        rows = rows.toDF(*columns)
        return name, rows.select(*(F.col(c).cast(t).alias(c) if c in columns else F.lit(None).cast(t).alias(c) for c, t in schema))

    def execute_many(self, statements: list[str | Statement]) -> list[DataFrame | int]:
        """Runs SELECTs and INSERTs in order: rows, or how many were added. All are checked first, and if one fails none counts."""
        checked = [(self._checked(s), s.params if isinstance(s, Statement) else None) for s in statements]
        before, out = self.frames, []
        try:
            for text, args in checked:
                if text.lstrip()[:6].upper() != "INSERT":
                    out.append(self.query(text, args))
                    continue
                name, rows = self._inserted(text, args)
                rows = self.spark.createDataFrame(rows.collect(), rows.schema) if re.search(r"\)\s*VALUES\b|^\s*INSERT\s+INTO\s+\S+\s+VALUES\b", text, re.I) else rows.checkpoint()  # what a statement lists, or a table
                self.insert({name: rows})
                out.append(rows.count())
        except Exception:
            self.frames = before
            raise
        return out

    def execute(self, statement: str | Statement) -> DataFrame | int:
        return self.execute_many([statement])[0]


def explode_reports(reports: DataFrame) -> dict[str, DataFrame]:
    """Nested incident reports (id, ..., suspects, evidences, victims) as the four tables.

    A child's id is 63 bits of the digest of its incident, kind and place: children of any number don't clash, and a report
    read again gives the same ids.
    """
    out = {"incidents": reports.select(*[c.split()[0] for c in TABLES["incidents"].split(", ")])}
    for name in ("suspects", "evidences", "victims"):
        columns = [c.split()[0] for c in TABLES[name].split(", ")][2:]
        rows = reports.select(F.col("id").alias("incident_id"), F.posexplode(name).alias("i", "r"))
        digest = F.sha2(F.concat_ws(":", F.col("incident_id").cast("string"), F.lit(name), F.col("i").cast("string")), 256)
        own = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        out[name] = rows.select(own.alias("id"), "incident_id", *(F.col(f"r.{c}").alias(c) for c in columns))
    return out
