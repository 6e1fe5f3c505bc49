"""Functions named in configuration: models, inference, data sets and filters of a run."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

TARGET = "_target_"


def resolve(name: str) -> Callable[..., Any]:
    """The function or class of a dotted name (`package.module.name`, or `package.module:name.inner`)."""
    module, _, inner = name.partition(":")
    parts = inner.split(".") if inner else []
    while True:
        try:
            found: Any = importlib.import_module(module)
            break
        except ModuleNotFoundError as e:
            # What is missing must be this name itself; what it imports in vain is an error of its own.
            head, _, last = module.rpartition(".")
            if inner or not head or not (module == e.name or module.startswith(f"{e.name}.")):
                raise
            module, parts = head, [last, *parts]
    for p in parts:
        found = getattr(found, p)
    if not callable(found):
        raise TypeError(f"{name} can't be called")
    return found


def call(config: dict[str, Any], *args: Any, default: str | None = None, **more: Any) -> Any:
    """Calls what config names in _target_ (or default, where it names nothing) with its other entries, which may hold
    configurations themselves; they are called first. Arguments given here go before those of config."""
    name = config.get(TARGET, default)
    if name is None:
        raise ValueError(f"no {TARGET} in {sorted(config)}")
    made = {k: call(v) if isinstance(v, dict) and TARGET in v else v for k, v in config.items() if k != TARGET}
    return resolve(name)(*args, **(made | more))
