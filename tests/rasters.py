"""Small frames for tests, as numpy arrays and as pixel rows."""

import numpy as np

SCHEMA = "frame_id long, x int, y int, r int, g int, b int, a int, width int, height int"


def frame(width, height, colour):
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    out[..., :3] = colour
    return out


def box(image, x, y, w, h, colour):
    image[y : y + h, x : x + w, :3] = colour
    return image


def pixel_rows(images, start=0):
    rows = []
    for i, image in enumerate(images, start):
        h, w = image.shape[:2]
        for y in range(h):
            for x in range(w):
                rows.append((i, x, y, *map(int, image[y, x]), w, h))
    return rows


def pixels(spark, *images):
    return spark.createDataFrame(pixel_rows(images), SCHEMA)


def streams(spark, **by_name):
    rows = []
    for name, images in by_name.items():
        for row in pixel_rows(images):
            rows.append((name, *row))
    return spark.createDataFrame(rows, "stream_id string, frame_no long, x int, y int, r int, g int, b int, a int, width int, height int")
