"""tideline: time-series collections, point clouds and linear dynamical models on PySpark."""
