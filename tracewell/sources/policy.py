"""A policy: defaults, and strict validation of what a user wrote."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column

from tracewell.operators.policy import EFFECTS, issued, strings


class PolicyError(ValueError):
    """A policy that may not be used; a broken one never falls back to defaults."""


@dataclass(frozen=True)
class Policy:
    mode: str = "interactive"
    effects: tuple[str, ...] = ("read", "summarize", "create", "update")
    paths: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    tools: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    trusted_sources: tuple[str, ...] = ()
    tools_return: Mapping[str, str] = field(default_factory=dict)
    journal: str | None = None
    exposure: bool = True
    task: str | None = None
    footer: bool = True


def _names(value: object, where: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise PolicyError(f"{where} must be a list of strings")
    return tuple(value)


def _effects(value: object, where: str) -> tuple[str, ...]:
    names = _names(value, where)
    if unknown := [n for n in names if n not in EFFECTS]:
        raise PolicyError(f"{where} has unknown effect classes: {', '.join(unknown)}")
    return names


def _table(value: object, where: str) -> dict:
    if not isinstance(value, dict):
        raise PolicyError(f"{where} must be a table")
    return value


def validate(parsed: object) -> Policy:
    """The policy in a parsed file: defaults where a field is absent, an error
    where it is wrong."""
    given, p = _table({} if parsed is None else parsed, "the policy"), Policy()
    mode = given.get("mode", p.mode)
    if mode not in ("interactive", "autonomous"):
        raise PolicyError(f"unknown mode: {mode}")
    profile = _table(given.get("profile", {}), "profile")
    bounds = _table(profile.get("resources", {}), "profile.resources")
    views = _table(given.get("toolsReturn", {}), "toolsReturn")
    for tool, view in views.items():
        if not tool.strip() or view not in ("rendered", "source"):
            raise PolicyError(f"toolsReturn: {tool!r} returns {view!r}")
    notify = _table(given.get("notify", {}), "notify")
    if "webhook" in notify:
        raise PolicyError("notify.webhook is not supported")
    output = _table(given.get("output", {}), "output")
    for name, value in (("exposure", given.get("exposure", True)), ("output.footer", output.get("footer", True))):
        if not isinstance(value, bool):
            raise PolicyError(f"{name} must be true or false")
    task = given.get("task")
    if task is not None and not isinstance(task, str):
        raise PolicyError("task must be a string")
    return Policy(
        mode,
        _effects(profile["effects"], "profile.effects") if "effects" in profile else p.effects,
        _names(bounds.get("paths", []), "profile.resources.paths"),
        _names(bounds.get("hosts", []), "profile.resources.hosts"),
        {tool: _effects(effects, f"tools.{tool}") for tool, effects in _table(given.get("tools", {}), "tools").items()},
        _names(given.get("trustedSources", []), "trustedSources"),
        dict(views),
        notify.get("file"),
        given.get("exposure", True),
        task,
        output.get("footer", True),
    )


def load(home: str) -> Policy:
    """The policy of ``home`` (policy.json, or policy.yaml where a YAML parser is
    installed); the defaults where there is none."""
    for name in ("policy.json", "policy.yaml"):
        path = Path(home, name)
        if path.exists():
            if name.endswith("json"):
                return validate(json.loads(path.read_text()))
            import yaml

            return validate(yaml.safe_load(path.read_text()))
    return Policy()


def certificate(policy: Policy, turn: Column) -> Column:
    """What a policy's profile permits, issued at a turn; no turn ends it."""
    return issued(strings(policy.effects), turn, policy.paths, policy.hosts)


def warnings(policy: Policy) -> list[str]:
    """What a diagnosis says of a policy that is valid but weak."""
    found = []
    if not policy.exposure:
        found.append("the exposure rule is off")
    if "exec" in policy.effects:
        found.append("exec is granted: a command is not parsed")
    if not policy.paths:
        found.append("paths are unbounded")
    if not policy.hosts and "network-egress" in policy.effects:
        found.append("hosts are unbounded")
    if any(not s.strip() for s in policy.trusted_sources):
        found.append("a blank trusted source is ignored")
    if policy.journal is None:
        found.append("decisions are not written to a journal")
    return found
