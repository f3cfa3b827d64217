"""OpenQASM 2 text to operation logs: a native lenient reader, and a faithful parser as a table function."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gates import LENIENT, NUM_CTRL

OPS_DDL = "pos int, gate string, qubits array<int>, clbits array<int>, params array<double>, cond struct<bits:array<int>,value:bigint>, num_ctrl int, n_qubits int, n_clbits int, error string"


class QasmError(ValueError):
    """A program that cannot be read; its text is the row's error."""


# --- expressions -----------------------------------------------------------------------------------------------------

_NUMBER = re.compile(r"\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_CALLS = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "exp": math.exp, "ln": math.log, "sqrt": math.sqrt, "acos": math.acos, "asin": math.asin, "atan": math.atan}


class _Expression:
    """Recursive descent over + - * / ^ (right to left), signs, calls, pi and names."""

    def __init__(self, text: str, names: dict[str, float]):
        self.text, self.at, self.names = text, 0, names

    def value(self) -> float:
        out = self._sum()
        self._skip()
        if self.at != len(self.text):
            raise QasmError(f"expression {self.text!r}")
        return out

    def _skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def _take(self, signs: str) -> str:
        self._skip()
        if self.at < len(self.text) and self.text[self.at] in signs:
            self.at += 1
            return self.text[self.at - 1]
        return ""

    def _sum(self) -> float:
        out = self._product()
        while sign := self._take("+-"):
            right = self._product()
            out = out + right if sign == "+" else out - right
        return out

    def _product(self) -> float:
        out = self._signed()
        while sign := self._take("*/"):
            right = self._signed()
            if sign == "/" and right == 0:
                raise QasmError(f"division by zero in {self.text!r}")
            out = out * right if sign == "*" else out / right
        return out

    def _signed(self) -> float:
        if sign := self._take("+-"):
            return -self._signed() if sign == "-" else self._signed()
        base = self._atom()
        if self._take("^"):
            return base ** self._signed()
        return base

    def _atom(self) -> float:
        if self._take("("):
            out = self._sum()
            if not self._take(")"):
                raise QasmError(f"bracket in {self.text!r}")
            return out
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            return float(m.group())
        if m := _NAME.match(self.text, self.at):
            self.at = m.end()
            name = m.group()
            if name in self.names:
                return self.names[name]
            if name == "pi":
                return math.pi
            if name in _CALLS and self._take("("):
                inner = self._sum()
                if not self._take(")"):
                    raise QasmError(f"bracket in {self.text!r}")
                return _CALLS[name](inner)
        raise QasmError(f"expression {self.text!r}")


def evaluate(text: str, names: dict[str, float] | None = None) -> float:
    try:
        return _Expression(text, names or {}).value()
    except (ValueError, OverflowError, ZeroDivisionError) as e:
        raise QasmError(str(e)) from e


def evaluate_or_zero(text: str) -> float:
    """The lenient reader's rule: what cannot be read is 0."""
    try:
        out = evaluate(text)
        return out if isinstance(out, float) and math.isfinite(out) else 0.0
    except QasmError:
        return 0.0


def split_args(text: str) -> list[str]:
    """Split at commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    tail = text[last:].strip()
    return [*out, tail] if tail or out else []


# --- programs --------------------------------------------------------------------------------------------------------


@dataclass
class Program:
    ops: list[tuple] = field(default_factory=list)  # gate, qubits, clbits, params, cond, num_ctrl
    n_qubits: int = 0
    n_clbits: int = 0


@dataclass
class _Gate:
    params: list[str]
    args: list[str]
    body: list[str]


_STATEMENT = re.compile(r"\s*(?:gate\b[^{}]*\{[^{}]*\}|[^;{}]+;)", re.S)
_CALL = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:\((.*)\))?\s*([^()]*)\Z", re.S)
_REG = re.compile(r"(qreg|creg)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\[\s*(\d+)\s*\]\Z")
_ARG = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:\[\s*(\d+)\s*\])?\Z")
_IF = re.compile(r"if\s*\(\s*([A-Za-z_][A-Za-z0-9_]*)\s*==\s*(\d+)\s*\)\s*(.*)\Z", re.S)
#: Names of the standard library, with the number of their parameters and qubits.
KNOWN = {
    "id": (0, 1), "x": (0, 1), "y": (0, 1), "z": (0, 1), "h": (0, 1), "s": (0, 1), "sdg": (0, 1), "t": (0, 1), "tdg": (0, 1), "sx": (0, 1), "sxdg": (0, 1),
    "rx": (1, 1), "ry": (1, 1), "rz": (1, 1), "p": (1, 1), "u1": (1, 1), "u2": (2, 1), "u3": (3, 1), "u": (3, 1), "U": (3, 1), "u0": (1, 1),
    "cx": (0, 2), "CX": (0, 2), "cy": (0, 2), "cz": (0, 2), "ch": (0, 2), "swap": (0, 2), "csx": (0, 2), "cp": (1, 2), "cu1": (1, 2), "cu3": (3, 2), "cu": (4, 2), "crx": (1, 2), "cry": (1, 2), "crz": (1, 2), "rxx": (1, 2), "ryy": (1, 2), "rzz": (1, 2),
    "ccx": (0, 3), "cswap": (0, 3), "rccx": (0, 3), "c3x": (0, 4), "rc3x": (0, 4), "c3sqrtx": (0, 4), "c4x": (0, 5),
}
_ALIASES = {"U": "u", "CX": "cx"}


class Parser:
    """One program, statement by statement. Gates of the text stay ops of their own name unless wider than ``expand_over``."""

    def __init__(self, expand_over: int | None = None, most_ops: int = 50_000):
        self.expand_over, self.most_ops = expand_over, most_ops
        self.q: dict[str, tuple[int, int]] = {}
        self.c: dict[str, tuple[int, int]] = {}
        self.gates: dict[str, _Gate] = {}
        self.out = Program()

    def parse(self, text: str) -> Program:
        text = re.sub(r"//[^\n]*", "", re.sub(r"/\*.*?\*/", "", text or "", flags=re.S))
        head = re.match(r"\s*OPENQASM\s+([0-9.]+)\s*;", text)
        if not text.strip():
            raise QasmError("empty program")
        if head and not head.group(1).startswith("2"):
            raise QasmError(f"unsupported version {head.group(1)}")
        at = head.end() if head else 0
        while at < len(text):
            m = _STATEMENT.match(text, at)
            if not m:
                if text[at:].strip():
                    raise QasmError(f"statement {text[at:].strip()[:40]!r}")
                break
            at = m.end()
            self._statement(m.group().strip().rstrip(";").strip())
        return self.out

    def _statement(self, s: str, cond: tuple | None = None) -> None:
        if not s or s.startswith("include"):
            return
        if m := _REG.match(s):
            kind, name, size = m.group(1), m.group(2), int(m.group(3))
            if name in self.q or name in self.c:
                raise QasmError(f"register {name!r} twice")
            if kind == "qreg":
                self.q[name] = (self.out.n_qubits, size)
                self.out.n_qubits += size
            else:
                self.c[name] = (self.out.n_clbits, size)
                self.out.n_clbits += size
        elif s.startswith("gate ") or s.startswith("gate\n") or s.startswith("gate\t"):
            self._define(s)
        elif s.startswith("opaque"):
            m = _CALL.match(s[6:].strip())
            self.gates[m.group(1)] = _Gate(split_args(m.group(2) or ""), split_args(m.group(3)), [])
        elif m := _IF.match(s):
            if m.group(1) not in self.c:
                raise QasmError(f"register {m.group(1)!r}")
            start, size = self.c[m.group(1)]
            self._statement(m.group(3).strip(), (list(range(start, start + size)), int(m.group(2))))
        elif s.startswith("measure"):
            left, _, right = s[7:].partition("->")
            qs, cs = self._places(left.strip(), self.q), self._places(right.strip(), self.c)
            if len(qs) != len(cs):
                raise QasmError(f"sizes in {s!r}")
            for a, b in zip(qs, cs, strict=True):
                self._emit("measure", [a], [b], [], cond, 0)
        elif re.match(r"reset\b", s):
            for a in self._places(s[5:].strip(), self.q):
                self._emit("reset", [a], [], [], cond, 0)
        elif re.match(r"barrier\b", s):
            args = split_args(s[7:]) or list(self.q)
            self._emit("barrier", [a for x in args for a in self._places(x, self.q)], [], [], cond, 0)
        else:
            self._call(s, cond)

    def _define(self, s: str) -> None:
        head, _, body = s[4:].partition("{")
        m = _CALL.match(head.strip())
        if not m:
            raise QasmError(f"gate {head.strip()!r}")
        self.gates[m.group(1)] = _Gate(split_args(m.group(2) or ""), split_args(m.group(3)), [b.strip() for b in body.rstrip().rstrip("}").split(";") if b.strip()])

    def _places(self, arg: str, table: dict[str, tuple[int, int]]) -> list[int]:
        m = _ARG.match(arg)
        if not m or m.group(1) not in table:
            raise QasmError(f"argument {arg!r}")
        start, size = table[m.group(1)]
        if m.group(2) is None:
            return list(range(start, start + size))
        if int(m.group(2)) >= size:
            raise QasmError(f"index in {arg!r}")
        return [start + int(m.group(2))]

    def _call(self, s: str, cond: tuple | None) -> None:
        m = _CALL.match(s)
        if not m:
            raise QasmError(f"statement {s!r}")
        name, params = _ALIASES.get(m.group(1), m.group(1)), [evaluate(p) for p in split_args(m.group(2) or "")]
        places = [self._places(a, self.q) for a in split_args(m.group(3))]
        self._check(name, len(params), len(places))
        wide = max(map(len, places))
        if any(len(p) not in (1, wide) for p in places):
            raise QasmError(f"sizes in {s!r}")
        for i in range(wide):
            qubits = [p[i] if len(p) > 1 else p[0] for p in places]
            if len(set(qubits)) != len(qubits):
                raise QasmError(f"repeated qubit in {s!r}")
            self._apply(name, params, qubits, cond)

    def _check(self, name: str, n_params: int, n_qubits: int) -> None:
        if name in self.gates:
            want = (len(self.gates[name].params), len(self.gates[name].args))
        elif name in KNOWN:
            want = KNOWN[name]
        else:
            raise QasmError(f"unknown gate {name!r}")
        if want != (n_params, n_qubits):
            raise QasmError(f"gate {name!r} takes {want[0]} parameters and {want[1]} qubits")

    def _apply(self, name: str, params: list[float], qubits: list[int], cond: tuple | None, depth: int = 0) -> None:
        own = self.gates.get(name)
        if own and own.body and self.expand_over is not None and len(qubits) > self.expand_over:
            if depth >= 16:
                raise QasmError(f"gate {name!r} is defined too deep")
            names, slots = dict(zip(own.params, params, strict=True)), dict(zip(own.args, qubits, strict=True))
            for b in own.body:
                if re.match(r"barrier\b", b):
                    continue
                m = _CALL.match(b)
                inner = _ALIASES.get(m.group(1), m.group(1))
                args = split_args(m.group(3))
                if any(a not in slots for a in args):
                    raise QasmError(f"argument in {b!r}")
                values = [evaluate(p, names) for p in split_args(m.group(2) or "")]
                self._check(inner, len(values), len(args))
                self._apply(inner, values, [slots[a] for a in args], cond, depth + 1)
            return
        self._emit(name, qubits, [], params, cond, 0 if own else NUM_CTRL.get(name, 0))

    def _emit(self, gate: str, qubits: list[int], clbits: list[int], params: list[float], cond: tuple | None, num_ctrl: int) -> None:
        if len(self.out.ops) >= self.most_ops:
            raise QasmError("too many ops")
        self.out.ops.append((gate, qubits, clbits, params, cond, num_ctrl))


def parse(text: str, expand_over: int | None = None) -> Program:
    """The program of a text; ``expand_over=0`` spells out all gates that the text defines."""
    return Parser(expand_over).parse(text)


def qasm_ops(expand_over: int | None = None):
    """Table function (text) -> rows of OPS_DDL; a text that cannot be read gives one row with its error."""

    @F.udtf(returnType=OPS_DDL)
    class QasmOps:
        def eval(self, text: str):
            try:
                p = parse(text, expand_over)
            except QasmError as e:
                yield (None, None, None, None, None, None, None, None, None, str(e))
                return
            for i, (gate, qubits, clbits, params, cond, n) in enumerate(p.ops):
                yield (i, gate, qubits, clbits, [float(x) for x in params], cond, n, p.n_qubits, p.n_clbits, None)
            if not p.ops:
                yield (None, None, None, None, None, None, None, p.n_qubits, p.n_clbits, None)

    return QasmOps


def read_programs(spark: SparkSession, folder: str, most_bytes: int = 800_000, pattern: str = "*.qasm") -> DataFrame:
    """(path, length, text) of every program below a folder; larger files are left out by their size alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.where(F.col("length") <= most_bytes).select("path", "length", F.col("content").cast("string").alias("text"))


def program_ops(programs: DataFrame, expand_over: int | None = None) -> DataFrame:
    """(circuit_id, OPS...) of programs (path, text), errors kept as rows."""
    f = qasm_ops(expand_over)
    return programs.select(F.col("path").alias("circuit_id"), "text").lateralJoin(f(F.col("text").outer())).drop("text")


def read_ops(spark: SparkSession, folder: str, expand_over: int | None = None) -> DataFrame:
    return program_ops(read_programs(spark, folder), expand_over)


# --- native reading --------------------------------------------------------------------------------------------------


def statements(text: Column) -> Column:
    """Statements without comments, trimmed, none empty."""
    cut = F.split(F.regexp_replace(text, "//[^\n]*", ""), ";")
    return F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def peek(programs: DataFrame) -> DataFrame:
    """(path, n_lines, n_qubits): lines that may be gates and declared qubits, before any parse."""
    lines = F.filter(F.split("text", "\n"), lambda s: (F.trim(s) != "") & ~F.trim(s).rlike(r"^(//|OPENQASM|include|qreg|creg|barrier|measure|gate|\{|\})"))
    widths = F.regexp_extract_all("text", F.lit(r"qreg\s+\w+\s*\[\s*(\d+)\s*\]"), F.lit(1))
    return programs.select("path", F.size(lines).alias("n_lines"), F.aggregate(widths, F.lit(0), lambda a, w: a + w.cast("int")).alias("n_qubits"))


def lenient_ops(programs: DataFrame) -> DataFrame:
    """(circuit_id, pos, gate, qubits, param_text): kept gates with indexed arguments only, one index space for all registers.

    Measures, resets, conditions, definitions, unknown gates and whole-register arguments are dropped; the number of qubits
    is not held against the gate's.
    """
    rows = programs.select(F.col("path").alias("circuit_id"), statements(F.regexp_replace("text", r"(?s)gate\s[^{}]*\{[^{}]*\}", "")).alias("s"))
    regs = rows.select("circuit_id", F.posexplode("s").alias("at", "st")).where(F.col("st").rlike(r"^qreg\b"))
    regs = regs.select("circuit_id", "at", F.regexp_extract("st", r"qreg (\w+) ?\[ ?(\d+)", 1).alias("reg"), F.regexp_extract("st", r"qreg (\w+) ?\[ ?(\d+)", 2).cast("int").alias("size"))
    from pyspark.sql.window import Window

    before = F.coalesce(F.sum("size").over(Window.partitionBy("circuit_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    regs = regs.withColumn("base", before).groupBy("circuit_id").agg(F.map_from_entries(F.collect_list(F.struct("reg", "base"))).alias("bases"))  # a program's registers
    gate = F.regexp_extract("st", r"^([a-z][a-z0-9]*)", 1)
    calls = rows.select("circuit_id", F.posexplode("s").alias("at", "st")).withColumn("gate", gate).where(F.col("gate").isin(*LENIENT))
    args = F.regexp_extract_all("st", F.lit(r"(\w+) ?\[ ?\d+ ?\]"), F.lit(1)), F.regexp_extract_all("st", F.lit(r"\w+ ?\[ ?(\d+) ?\]"), F.lit(1))
    calls = calls.withColumn("regs", args[0]).withColumn("idx", args[1]).join(regs, "circuit_id")
    known = F.forall("regs", lambda r: F.map_contains_key("bases", r))
    calls = calls.where((F.size("regs") > 0) & known)
    qubits = F.zip_with("regs", "idx", lambda r, i: F.element_at("bases", r) + i.cast("int"))
    params = F.regexp_extract("st", r"^[a-z][a-z0-9]* ?\((.*)\) ?[A-Za-z_]", 1)
    out = calls.select("circuit_id", "at", "gate", qubits.alias("qubits"), params.alias("param_text"))
    return out.select("circuit_id", (F.row_number().over(Window.partitionBy("circuit_id").orderBy("at")) - 1).alias("pos"), "gate", "qubits", "param_text")


def with_params(ops: DataFrame) -> DataFrame:
    """``param_text`` evaluated to ``params``; what cannot be read is 0."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def values(text: pd.Series) -> pd.Series:
        return text.map(lambda s: [evaluate_or_zero(p) for p in split_args(s or "")])

    return ops.withColumn("params", values("param_text")).drop("param_text")
