"""Extensions: methods added to classes and functions of this package by other packages.

An extensible class gets registered methods as attributes; an extensible function stays callable
and has its extensions as attributes, called with the function's result.  Entry points of the
group ``tallymark.plugins`` are loaded when an extension is first looked up; a plugin that fails
to load is reported and the others go on.
"""

from __future__ import annotations

import functools
import operator
import sys
from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any

GROUP = "tallymark.plugins"


class ExtensibleResult:
    """A function's result that also offers the function's extensions; all else is the result's."""

    def __init__(self, value: Any, name: str) -> None:
        object.__setattr__(self, "_value", value)
        object.__setattr__(self, "_name", name)

    def __getattr__(self, name: str) -> Any:
        found = plugins.functions(self._name).get(name)
        return functools.partial(found, self._value) if found else getattr(self._value, name)

    def unwrap(self) -> Any:
        return self._value

    def __iter__(self) -> Any:
        return iter(self._value)

    def __getitem__(self, key: Any) -> Any:
        return self._value[key]

    def __len__(self) -> int:
        return len(self._value)

    def __contains__(self, item: Any) -> bool:
        return item in self._value

    def __bool__(self) -> bool:
        return bool(self._value)

    def __setitem__(self, key: Any, value: Any) -> None:
        self._value[key] = value

    def __eq__(self, other: object) -> Any:
        return self._value == other

    def __hash__(self) -> int:
        return hash(self._value)

    def __repr__(self) -> str:
        return repr(self._value)


def _forwarded(name: str) -> Callable:
    """A binary operator of the result; an operand that is a result itself is unwrapped."""

    def method(self: ExtensibleResult, other: Any) -> Any:
        return getattr(operator, name)(self._value, other.unwrap() if isinstance(other, ExtensibleResult) else other)

    def turned(self: ExtensibleResult, other: Any) -> Any:
        return getattr(operator, name)(other, self._value)

    return method, turned


for _name in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "and_", "or_", "xor", "matmul"):
    _plain, _turned = _forwarded(_name)
    setattr(ExtensibleResult, f"__{_name.strip('_')}__", _plain)
    setattr(ExtensibleResult, f"__r{_name.strip('_')}__", _turned)
for _name in ("lt", "le", "gt", "ge", "ne"):
    setattr(ExtensibleResult, f"__{_name}__", _forwarded(_name)[0])
for _name in ("neg", "pos", "abs", "invert"):
    setattr(ExtensibleResult, f"__{_name}__", lambda self, _name=_name: getattr(operator, _name)(self._value))


class Plugins:
    """What is registered, by the name of the class or function."""

    def __init__(self) -> None:
        self._methods: dict[str, dict[str, Callable]] = {}
        self._functions: dict[str, dict[str, Callable]] = {}
        self._loaded = False
        self.failures: list[str] = []

    def register_method(self, target: type, name: str, method: Callable) -> None:
        self._methods.setdefault(target.__name__, {})[name] = method

    def register_function_extension(self, target: Callable, name: str, method: Callable) -> None:
        self._functions.setdefault(target.__name__, {})[name] = method

    def load(self) -> None:
        if self._loaded:
            return
        self._loaded = True
        for point in entry_points(group=GROUP):
            try:
                point.load()(self)
            except Exception as error:  # noqa: BLE001 - one plugin must not stop the others
                self.failures.append(f"{point.name}: {error}")
        if self.failures:
            print("Plugins that failed to load:", *self.failures, sep="\n- ", file=sys.stderr)

    def methods(self, name: str) -> dict[str, Callable]:
        self.load()
        return self._methods.get(name, {})

    def functions(self, name: str) -> dict[str, Callable]:
        self.load()
        return self._functions.get(name, {})

    def extensible(self, target: Any) -> Any:
        """Class or function decorator."""
        if isinstance(target, type):

            def lookup(self: Any, name: str) -> Any:
                found = plugins.methods(target.__name__).get(name)
                if found is None:
                    raise AttributeError(f"{target.__name__!r} object has no attribute {name!r}")
                return functools.partial(found, self)

            target.__getattr__ = lookup
            return target

        @functools.wraps(target)
        def called(*args: Any, **kwargs: Any) -> Any:
            value = target(*args, **kwargs)
            return ExtensibleResult(value, target.__name__) if plugins.functions(target.__name__) else value

        return called


plugins = Plugins()
