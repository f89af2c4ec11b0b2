"""Named transforms with declared arguments, checked before they run."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class ArgumentError(ValueError):
    """A transform was called with arguments it does not take."""


@dataclass(frozen=True)
class Argument:
    """One declared argument: its type, whether it must be given, and what it may be."""

    type: type = str
    required: bool = True
    choices: tuple = ()
    default: object = None

    def read(self, name: str, value):
        if self.choices and value not in self.choices:
            raise ArgumentError(f"{name}: {value!r} is not one of {', '.join(map(str, self.choices))}")
        if self.type is bool:
            if str(value).lower() not in ("true", "false", "1", "0"):
                raise ArgumentError(f"{name} must be a bool")
            return str(value).lower() in ("true", "1")
        try:
            return self.type(value)
        except (TypeError, ValueError):
            raise ArgumentError(f"{name} must be a {self.type.__name__}") from None


def _canonical(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


@dataclass
class Transforms:
    """A registry of functions from a DataFrame and arguments to a DataFrame."""

    entries: dict = field(default_factory=dict)

    def register(self, name: str, **arguments: Argument):
        """Decorator adding a transform; a name that differs only in case or separators is refused."""

        def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if _canonical(name) in self.entries:
                raise ValueError(f"{name} is registered twice")
            self.entries[_canonical(name)] = (name, arguments, fn)
            return fn

        return add

    def find(self, name: str):
        """(name, arguments, function), however the name is spelled."""
        try:
            return self.entries[_canonical(name)]
        except KeyError:
            raise KeyError(f"Unknown transform: {name!r}") from None

    def run(self, name: str, df: DataFrame, **given) -> DataFrame:
        """Check the arguments and run the transform."""
        _, arguments, fn = self.find(name)
        unknown = sorted(set(given) - set(arguments))
        if unknown:
            raise ArgumentError(f"Unexpected argument(s): {', '.join(unknown)}")
        ready = {}
        for key, argument in arguments.items():
            if given.get(key) is not None:
                ready[key] = argument.read(key, given[key])
            elif argument.required:
                raise ArgumentError(f"Missing argument: {key}")
            elif argument.default is not None:
                ready[key] = argument.default
        return fn(df, **ready)

    def dispatch(self, name: str, targets: Mapping[str, str]) -> None:
        """Register a transform that hands over to one of several by its `mode` argument.

        It takes every argument of its targets; one that not all of them have is optional.
        """
        found = {mode: self.find(target) for mode, target in targets.items()}
        merged: dict[str, Argument] = {}
        for _, arguments, _ in found.values():
            for key, argument in arguments.items():
                known = merged.setdefault(key, argument)
                if (known.type, known.choices, known.required) != (argument.type, argument.choices, argument.required):
                    raise ArgumentError(f"{key} means two things in {name}")
        everywhere = {k for k in merged if all(k in arguments for _, arguments, _ in found.values())}
        published = {k: a if k in everywhere else Argument(a.type, False, a.choices, None) for k, a in merged.items()}

        @self.register(name, mode=Argument(str, True, tuple(targets)), **published)
        def run_mode(df: DataFrame, mode: str, **given) -> DataFrame:
            target = targets[mode]
            wanted = self.find(target)[1]
            return self.run(target, df, **{k: v for k, v in given.items() if k in wanted})
