"""Stateful operators over streams of frames and detections."""
