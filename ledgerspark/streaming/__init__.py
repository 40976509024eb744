"""The tag costs over a stream of usage."""
