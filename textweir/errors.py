"""Named refusals: a scan that could not look must not report that it found nothing."""


class TextweirError(Exception):
    """Base of all refusals."""


class MissingValueError(TextweirError):
    """A flag without its value."""


class UnknownFlagError(TextweirError):
    """A flag that does not exist."""


class InputMissingError(TextweirError):
    """A file that does not exist."""


class SchemaMismatchError(TextweirError):
    """No record carries the text field."""


class EmptyBatchError(TextweirError):
    """No usable record."""


class EmptyCorpusError(TextweirError):
    """No readable document: a clean result would mean nothing."""


class EmptyBenchmarkError(TextweirError):
    """No item to index."""


class ThresholdError(TextweirError):
    """A threshold that is no positive integer."""


class IndexMissingError(TextweirError):
    """No index of that path or name."""


class IndexUnreadableError(TextweirError):
    """Not an index file."""


class IndexVersionError(TextweirError):
    """An index of another format version."""


class IndexTruncatedError(TextweirError):
    """An index whose parts do not have the promised sizes."""


class BenchmarkMismatchError(TextweirError):
    """Benchmark text that is not what the index was built from."""


class BatchTooSmallError(TextweirError):
    """Too few records to score."""


class TooFewTextsError(TextweirError):
    """Fewer than two distinct texts."""


class NotFiniteError(TextweirError):
    """A signal or score that is no number."""


class MissingDocumentError(TextweirError):
    """Evidence names a document that the corpus does not hold."""
