"""Classed errors and warnings; every error is a TopicError."""

from __future__ import annotations


class TopicError(ValueError):
    """Base of all errors raised by this package."""


class BadInput(TopicError):
    pass


class NoEmbeddings(TopicError):
    pass


class DimensionMismatch(TopicError):
    pass


class ModelNotInstalled(TopicError):
    pass


class RuntimeMissing(TopicError):
    pass


class UnknownModel(TopicError):
    pass


class CacheInvalid(TopicError):
    pass


class DownloadFailed(TopicError):
    pass


class ModelError(TopicError):
    pass


class NoTerms(TopicError):
    pass


class ClusteringFailed(TopicError):
    pass


class NoFittedModel(TopicError):
    pass


class BadTopicNames(TopicError):
    pass


class TopicWarning(UserWarning):
    """Base of all warnings."""


class NotConverged(TopicWarning):
    pass


class CacheRebuilt(TopicWarning):
    pass


class FewRepresentatives(TopicWarning):
    pass
