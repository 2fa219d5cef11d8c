"""What can go wrong, as kinds of ValueError, so that callers who only ask for that see all of them."""

from __future__ import annotations


class DicomError(ValueError):
    """Anything wrong with DICOM data or with what is asked of it."""


class InvalidDicomError(DicomError):
    """Data that are no DICOM file."""


class SyntaxUnknownError(DicomError):
    """A transfer syntax that no dictionary has, or that no codec is registered for."""

    def __init__(self, uid: str | None, what: str = "unknown transfer syntax"):
        super().__init__(f"{what} {uid}")
        self.uid = uid

    def __reduce__(self) -> tuple:
        return type(self), (self.uid, str(self).removesuffix(f" {self.uid}"))


class MetaError(DicomError):
    """File meta information that is missing or stands in the wrong place."""


class EncodingError(DicomError):
    """Options of writing that contradict each other."""
