"""Image features: numpy kernels and the Arrow functions that run them on image columns."""
