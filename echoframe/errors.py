"""Errors.  Checks come before results: a call that raises has handed out nothing."""


class CloneError(Exception):
    """Base of all errors of the clone engine."""


class InvalidConfig(CloneError):
    def __init__(self, field: str, reason: str):
        super().__init__(f"setting {field} {reason}")
        self.field, self.reason = field, reason


class InvalidFragment(CloneError):
    def __init__(self, fragment: str, reason: str):
        super().__init__(f"can not use fragment {fragment!r}: {reason}")
        self.fragment, self.reason = fragment, reason


class DuplicateFragment(CloneError):
    def __init__(self, fragment: str):
        super().__init__(f"two fragments are called {fragment!r}")
        self.fragment = fragment


class CapacityExceeded(CloneError):
    def __init__(self, resource: str, limit: int):
        super().__init__(f"there are more {resource} than the {limit} that are allowed")
        self.resource, self.limit = resource, limit


class InvalidOutput(CloneError):
    def __init__(self, message: str):
        super().__init__(f"can not encode: {message}")


class AccuracyGateFailed(CloneError):
    def __init__(self, metric: str, actual: int, required: int):
        super().__init__(f"{metric} is {actual} of 1000, which asks for {required} or more")
        self.metric, self.actual, self.required = metric, actual, required


class RepositoryError(CloneError):
    def __init__(self, message: str):
        super().__init__(f"reading the folder: {message}")
