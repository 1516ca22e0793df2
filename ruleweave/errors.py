"""What can be wrong with a program of tables and rules."""


class RuleError(ValueError):
    """Any error of this library's own."""


class TableExists(RuleError):
    pass


class NoSuchTable(RuleError):
    pass


class WrongArity(RuleError):
    pass


class TypeMismatch(RuleError):
    pass


class UnsafeRule(RuleError):
    """A result column that no positive input binds, or a rule with no positive input."""


class NotStratified(RuleError):
    """A table that depends on its own absence or on an aggregate of itself."""


class RoundLimit(RuleError):
    """A recursion that did not settle within its rounds."""


class NullValue(RuleError):
    """Relations hold no nulls."""


class BadLocation(RuleError):
    """A location that isn't tcp:host:port."""


class Unconnected(RuleError):
    """A join without shared columns or condition, which would be a product."""
