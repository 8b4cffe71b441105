"""Operators over frames, pixels, runs, rectangles and detections."""
