"""Readers, writers and constructors of collections."""

from tideline.sources.io import *  # noqa: F403
