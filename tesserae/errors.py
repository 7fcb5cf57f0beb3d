"""Errors, from the general to the particular."""


class TesseraeError(Exception):
    """Any failure that this library reports."""


class DependencyError(TesseraeError):
    """Something that a job needs is not at hand, a decoder for instance."""


class ConfigurationError(TesseraeError, ValueError):
    """A parameter or a source that can't be used."""


class PipelineError(TesseraeError):
    """A vectorisation that can't go on."""


class StageExecutionError(PipelineError):
    def __init__(self, stage: str, message: str, *, cause: Exception | None = None):
        super().__init__(f"{stage}: {message}")
        self.stage, self.cause = stage, cause


class ExportError(TesseraeError):
    """A sink that can't be written."""


class GeometryError(TesseraeError):
    """Coordinates that make no geometry."""
