"""haloscape: DataFrame-first analytics for raster scenes, adjacency effects and parameter sweeps."""

__version__ = "0.1.0"
