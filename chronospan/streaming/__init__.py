"""Rolling scores over a stream of frames."""
