"""Tools by name: registry, permission lattice, executor with retries and an idempotency cache; three built-in tools."""

from __future__ import annotations

import ast
import datetime as dt
import json
import operator
import time
from collections.abc import Callable
from dataclasses import dataclass

# Who may use what; a caller's rank must reach the tool's.
CALLERS = {"anonymous": 0, "authenticated": 1, "admin": 2}
PERMISSIONS = {"public": 0, "internal": 1, "restricted": 2}
OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[[dict], object]
    required: tuple[str, ...] = ()
    permission: str = "public"
    idempotent: bool = True
    fallback: Callable[[dict], object] | None = None


class ToolError(Exception):
    pass


def calculate(args: dict) -> dict:
    """The value of an arithmetic expression without powers, or whether an actual value reaches a threshold."""
    if "expression" in args:

        def value(n: ast.AST) -> float:
            if isinstance(n, ast.Constant) and type(n.value) in (int, float):
                return n.value
            if isinstance(n, ast.BinOp) and type(n.op) in OPERATORS:
                return OPERATORS[type(n.op)](value(n.left), value(n.right))
            if isinstance(n, ast.UnaryOp) and type(n.op) in OPERATORS:
                return OPERATORS[type(n.op)](value(n.operand))
            raise ToolError(f"not arithmetic: {args['expression']}")

        try:
            return {"result": float(value(ast.parse(args["expression"].strip(), mode="eval").body))}
        except (SyntaxError, ZeroDivisionError) as e:
            raise ToolError(str(e)) from e
    if {"actual", "threshold"} <= args.keys():
        a, t = float(args["actual"]), float(args["threshold"])
        return {"actual": a, "threshold": t, "compliant": a >= t, "margin": a - t}
    raise ToolError("needs expression, or actual and threshold")


# The layouts of dates, in the order in which they are tried.
DAY_LAYOUTS = ("%Y-%m-%d", "%Y/%m/%d", "%Y年%m月%d日", "%Y%m%d", "%d/%m/%Y")


def day_of(text: str) -> dt.date:
    for layout in DAY_LAYOUTS:
        try:
            return dt.datetime.strptime(text, layout).date()
        except ValueError:
            continue
    raise ToolError(f"no date: {text}")


def parse_day(args: dict) -> dict:
    """ISO date of a text in one of five layouts; or, of date1 and date2, which comes first and the days between them."""
    if "text" in args:
        return {"date": day_of(args["text"]).isoformat()}
    if {"date1", "date2"} <= args.keys():
        a, b = day_of(args["date1"]), day_of(args["date2"])
        return {"date1": a.isoformat(), "date2": b.isoformat(), "comparison": "before" if a < b else "after" if a > b else "equal", "days": abs((a - b).days)}
    raise ToolError("needs text, or date1 and date2")


def version_in_force(args: dict) -> dict:
    """Whether a version is in force at a day: effective <= day < superseded (ISO dates; superseded may be missing)."""
    until = args.get("superseded")
    return {"in_force": args["effective"] <= args["day"] and (not until or args["day"] < until)}


BUILT_IN = (Tool("calculator", calculate), Tool("date_parser", parse_day), Tool("version_checker", version_in_force, ("effective", "day")))


class Registry:
    def __init__(self, tools: tuple[Tool, ...] = BUILT_IN):
        self._tools: dict[str, Tool] = {}
        for t in tools:
            self.add(t)

    def add(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ToolError(f"{tool.name} is registered already")
        self._tools[tool.name] = tool

    def get(self, name: str) -> Tool:
        if name not in self._tools:
            raise ToolError(f"unknown tool {name}")
        return self._tools[name]


class Executor:
    """Validate, permit, answer from the cache, run with retries, fall back; each call leaves an audit row."""

    def __init__(self, registry: Registry, retries: int = 2, sleep: Callable[[float], None] = time.sleep):
        self.registry, self.retries, self.sleep, self.audit, self._done = registry, retries, sleep, [], {}

    def run(self, name: str, args: dict, caller: str = "anonymous") -> object:
        tool, key = self.registry.get(name), (name, json.dumps(args, sort_keys=True, default=str))
        missing = [r for r in tool.required if r not in args]
        if missing:
            return self._end(name, caller, "invalid", error=ToolError(f"{name} needs {', '.join(missing)}"))
        if CALLERS.get(caller, 0) < PERMISSIONS[tool.permission]:
            return self._end(name, caller, "denied", error=ToolError(f"{caller} may not use {name}"))
        if tool.idempotent and key in self._done:
            return self._end(name, caller, "cached", self._done[key])
        for n in range(self.retries + 1):
            try:
                out = tool.run(args)
            except ToolError as e:  # what the arguments make impossible does not get better
                last = e
                break
            except Exception as e:  # noqa: BLE001 - any other failure of a tool is retried
                last = e
                if n < self.retries:
                    self.sleep(min(0.5 * 2**n, 10.0))
                continue
            if tool.idempotent:
                self._done[key] = out
            return self._end(name, caller, "ok", out)
        if tool.fallback:
            return self._end(name, caller, "fallback", tool.fallback(args))
        return self._end(name, caller, "failed", error=last)

    def _end(self, name: str, caller: str, state: str, out: object = None, error: Exception | None = None) -> object:
        self.audit.append({"tool": name, "caller": caller, "state": state})
        if error:
            raise error
        return out
