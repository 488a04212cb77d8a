"""Cross-sectional panel analytics on Spark: frames in, frames out, planned by Catalyst."""
