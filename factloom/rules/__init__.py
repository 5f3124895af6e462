"""The rule catalogue, by family of facts."""

from factloom.rules import calls, classes, data, functions, languages, modules, operations, overrides, python, syntax, testing  # noqa: F401
