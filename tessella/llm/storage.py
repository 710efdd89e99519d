"""Tables that outlive an executor, in the folder that the cluster shares."""

from tessella.sources.shared import new_path, purge, shared_dir, sized, small_batches, written

__all__ = ["new_path", "purge", "shared_dir", "sized", "small_batches", "written"]
