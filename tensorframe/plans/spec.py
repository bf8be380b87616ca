"""The einsum grammar: ``ab,bc->ac``; any number of inputs, one or more outputs.

Indices are lower-case letters; blanks are ignored and nothing else is. An
empty output is a scalar, so ``ab->ab,`` has two outputs. Letters may repeat
within an operand (a diagonal) and within an output.
"""

from __future__ import annotations

from dataclasses import dataclass


class InvalidSpec(ValueError):
    """A spec that cannot be parsed or does not fit its tensors; each kind has its fields and message."""

    message = ""
    fields: tuple[str, ...] = ()

    def __init__(self, **values):
        self.__dict__.update(values)
        super().__init__(self.message.format(**values))

    def __eq__(self, other):
        return type(self) is type(other) and all(getattr(self, f) == getattr(other, f) for f in self.fields)

    __hash__ = ValueError.__hash__


# The kinds of error with their fields and messages.
class MissingArrow(InvalidSpec):
    message = "missing '->'"


class InvalidIndex(InvalidSpec):
    message, fields = "index '{ch}' is not a lowercase letter", ("ch",)


class WrongInputCount(InvalidSpec):
    message, fields = "expected {expected} input(s), got {got}", ("expected", "got")


class EmptyInput(InvalidSpec):
    message, fields = "input {input} has no indices", ("input",)


class UnboundOutputIndex(InvalidSpec):
    message, fields = "output index '{index}' does not appear in any input", ("index",)


class InputNdimMismatch(InvalidSpec):
    message, fields = "input {input} has {array_ndim} dimensions but spec has {spec_ndim} indices", ("input", "array_ndim", "spec_ndim")


class DimensionMismatch(InvalidSpec):
    message, fields = "dimension mismatch for index '{index}': {expected} vs {got}", ("index", "expected", "got")


class OutputNdimMismatch(InvalidSpec):
    message, fields = "output has {array_ndim} dimensions but spec has {spec_ndim} output indices", ("array_ndim", "spec_ndim")


class OutputDimMismatch(InvalidSpec):
    message, fields = "output dimension {axis} is {got} but expected {expected}", ("axis", "expected", "got")


class NonEmptyScalarOutput(InvalidSpec):
    message = "scalar output must have no indices"


@dataclass(frozen=True)
class Spec:
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]

    @property
    def letters(self) -> set[str]:
        return set("".join(self.inputs))


def parse_spec(text: str, n_inputs: int | None = None) -> Spec:
    """Parses ``text``; ``n_inputs`` is the number of tensors given."""
    left, arrow, right = text.replace(" ", "").partition("->")
    if not arrow:
        raise MissingArrow

    def operands(side: str) -> tuple[str, ...]:
        if bad := next((c for c in side if c != "," and not "a" <= c <= "z"), None):
            raise InvalidIndex(ch=bad)
        return tuple(side.split(","))

    inputs = operands(left)
    if n_inputs is not None and len(inputs) != n_inputs:
        raise WrongInputCount(expected=n_inputs, got=len(inputs))
    if "" in inputs:
        raise EmptyInput(input=inputs.index(""))
    outputs = operands(right)
    if bad := next((c for o in outputs for c in o if c not in left), None):
        raise UnboundOutputIndex(index=bad)
    return Spec(inputs, outputs)


def bind(spec: Spec, shapes: list[tuple[int, ...]]) -> dict[str, int]:
    """The size of every index; operands are checked one after the other."""
    sizes: dict[str, int] = {}
    for k, (letters, shape) in enumerate(zip(spec.inputs, shapes, strict=True)):
        if len(shape) != len(letters):
            raise InputNdimMismatch(input=k, array_ndim=len(shape), spec_ndim=len(letters))
        for letter, size in zip(letters, shape, strict=True):
            if sizes.setdefault(letter, size) != size:
                raise DimensionMismatch(index=letter, expected=sizes[letter], got=size)
    return sizes


def check_outputs(spec: Spec, sizes: dict[str, int], shapes: list[tuple[int, ...]]) -> None:
    """Checks shapes that a caller expects of the outputs."""
    if len(shapes) != len(spec.outputs):
        raise WrongInputCount(expected=len(spec.outputs), got=len(shapes))
    for letters, shape in zip(spec.outputs, shapes, strict=True):
        if len(shape) != len(letters):
            raise OutputNdimMismatch(array_ndim=len(shape), spec_ndim=len(letters))
        for axis, (letter, got) in enumerate(zip(letters, shape, strict=True)):
            if got != sizes[letter]:
                raise OutputDimMismatch(axis=axis, expected=sizes[letter], got=got)
