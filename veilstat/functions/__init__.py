"""Scalar functions: noise distributions, calibration of noise, and checks of arguments."""
