"""Wi-Fi capture analytics as Spark DataFrame operations."""

from airsift.operators.normalize import normalize
from airsift.plans.analysis import Analysis, analyze
from airsift.sources.frames import read_frames, read_frame_store

__all__ = ["Analysis", "analyze", "normalize", "read_frames", "read_frame_store"]
