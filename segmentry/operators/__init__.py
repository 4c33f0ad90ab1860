"""DataFrame operators: cleaning, profiling, features, segmentation."""
