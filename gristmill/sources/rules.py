"""Classification rules: a handful of patterns and thresholds, kept on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    symbol_regex: tuple[str, ...]
    dso_regex: tuple[str, ...] = ()
    self_percent_gte: float = 0.0
    inclusive_percent_gte: float = 0.0
    confidence: str = "low"
    version: int = 1
    scope: str = "generic"
    observation: str = "{symbol} carries notable sampled weight."
    limitations: tuple[str, ...] = ()
    missing_evidence: tuple[str, ...] = ()
    next_steps: tuple[str, ...] = ()
    forbidden_conclusions: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.symbol_regex:
            raise ValueError(f"rule {self.id!r} has no symbol pattern")
        if self.confidence not in ("low", "medium"):
            raise ValueError(f"rule {self.id!r} has an unknown confidence")
        if self.scope not in ("generic", "linux", "cpp"):
            raise ValueError(f"rule {self.id!r} has an unknown scope")
        for pattern in (*self.symbol_regex, *self.dso_regex):
            re.compile(pattern)


# fixed values: ids, patterns, thresholds and categories of the built-in rules, in rule order
BUILTIN_RULES = (
    Rule(
        id="generic-allocation-hotspot",
        category="memory-allocation",
        symbol_regex=(r"(^|::)(malloc|calloc|realloc|free)$", r"operator (new|delete)"),
        self_percent_gte=1,
        inclusive_percent_gte=1,
        observation="{symbol} allocates or frees memory and carries notable sampled weight.",
        limitations=("Sampling shows time on the processor, not how many objects were made or how large.",),
        missing_evidence=("No allocation counts or sizes were recorded.",),
        next_steps=("Look at the paths into the allocator and record allocation sizes.",),
        forbidden_conclusions=("That the allocator itself is the cause.",),
    ),
    Rule(
        id="generic-memory-copy-hotspot",
        category="memory-copy",
        symbol_regex=(r"(^|::)(memcpy|memmove)$", r"copy"),
        self_percent_gte=1,
        inclusive_percent_gte=1,
        observation="{symbol} copies data and carries notable sampled weight.",
        limitations=("Sampling shows neither the bytes copied nor who owns the buffers.",),
        missing_evidence=("No copy sizes or call counts were recorded.",),
        next_steps=("Record copy sizes and look for repeated conversions and temporary buffers.",),
        forbidden_conclusions=("That all copies can be removed safely.",),
    ),
    Rule(
        id="generic-system-call-hotspot",
        category="system-call",
        symbol_regex=(r"(^|::)(read|write|send|recv|sendmsg|recvmsg|epoll_wait|poll|fsync)$",),
        self_percent_gte=1,
        inclusive_percent_gte=1,
        observation="{symbol} enters the kernel and carries notable sampled weight.",
        limitations=("Sampling on the processor does not see blocked time or the device behind the call.",),
        missing_evidence=("No off-CPU time, request sizes or device counters were recorded.",),
        next_steps=("Count the calls and record off-CPU time or device counters.",),
        forbidden_conclusions=("That the disk or the network is the cause.",),
    ),
    Rule(
        id="linux-synchronization-hotspot",
        category="synchronization",
        scope="linux",
        symbol_regex=(r"pthread_(mutex|rwlock)", r"(^|::)futex", r"std::.*mutex"),
        inclusive_percent_gte=2,
        observation="{symbol} synchronizes threads and lies on a heavy call path.",
        limitations=("Sampling on the processor shows little of lock waits and nothing of their owners.",),
        missing_evidence=("No lock waits, owners or off-CPU times were recorded.",),
        next_steps=("Record lock, scheduler or off-CPU events.",),
        forbidden_conclusions=("That lock contention is the cause.",),
    ),
    Rule(
        id="linux-kernel-hotspot",
        category="kernel",
        scope="linux",
        symbol_regex=(r".+",),
        dso_regex=(r"^\[kernel",),
        self_percent_gte=1,
        inclusive_percent_gte=1,
        observation="Kernel symbol {symbol} carries notable sampled weight.",
        limitations=("Kernel time alone does not tell whether the program or the kernel is at fault.",),
        missing_evidence=("No system-call, scheduling or system counters were related to it.",),
        next_steps=("Look at the paths from user code into the kernel beside system counters.",),
        forbidden_conclusions=("That the kernel is defective.",),
    ),
    Rule(
        id="cpp-runtime-hotspot",
        category="runtime",
        scope="cpp",
        symbol_regex=(r"__cxa_", r"std::.*(construct|destroy|locale|iostream)"),
        self_percent_gte=1,
        inclusive_percent_gte=1,
        observation="{symbol} belongs to the C++ runtime and carries notable sampled weight.",
        limitations=("A symbol name tells neither object counts nor whether the work is needed.",),
        missing_evidence=("No object lifetimes or call counts were recorded.",),
        next_steps=("Look at the callers and count operations before changing lifetimes.",),
        forbidden_conclusions=("That the C++ runtime is the cause.",),
    ),
)


def rule_from(document: dict) -> Rule:
    """A rule from its document form (``match``, ``thresholds``, ``classification`` …)."""
    known = {
        "id", "version", "scope", "match", "thresholds", "classification", "observation",
        "limitations", "missing_evidence", "next_steps", "forbidden_conclusions",
    }
    if set(document) - known:
        raise ValueError(f"unknown rule fields {sorted(set(document) - known)}")
    match, limits, result = document["match"], document.get("thresholds", {}), document["classification"]
    texts = {
        name: tuple(document[name])
        for name in ("limitations", "missing_evidence", "next_steps", "forbidden_conclusions")
    }
    return Rule(
        id=document["id"],
        version=int(document["version"]),
        scope=document["scope"],
        category=result["category"],
        confidence=result["confidence"],
        symbol_regex=tuple(match["symbol_regex"]),
        dso_regex=tuple(match.get("dso_regex", ())),
        self_percent_gte=float(limits.get("self_percent_gte", 0)),
        inclusive_percent_gte=float(limits.get("inclusive_percent_gte", 0)),
        observation=document["observation"],
        **texts,
    )


def load_rules(path: str) -> tuple[Rule, ...]:
    """Rules of a YAML (or JSON) file: one document or a list of them."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    return tuple(rule_from(item) for item in (raw if isinstance(raw, list) else [raw]))
