"""Small files beside tables: listing, reading and writing them wherever Spark can."""

END = "# end\n"


class Folder:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark, path):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name):
        return self._hadoop.Path(f"{self.path}/{name}")

    def names(self, pattern):
        """Paths below the folder that match, sorted."""
        found = self._fs.globStatus(self._at(pattern)) or []
        root = self._fs.makeQualified(self._hadoop.Path(self.path)).toUri().getPath()
        return sorted(status.getPath().toUri().getPath()[len(root) + 1:] for status in found)

    def signature(self, pattern="*"):
        """Names, sizes and times of the matching files: changes when they do."""
        found = self._fs.globStatus(self._at(pattern)) or []
        return tuple(sorted(
            (s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found
        ))

    def write_new(self, name, text):
        """Write a file that must not exist yet; ``FileExistsError`` if another writer was first."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as error:
            if self._fs.exists(self._at(name)):
                raise FileExistsError(f"{self.path}/{name}") from error
            raise
        try:
            out.write((text + END).encode())
        finally:
            out.close()

    def read(self, name):
        """The text of a file, or None where its writer did not come to the end."""
        stream = self._fs.open(self._at(name))
        try:
            charset = self._jvm.java.nio.charset.StandardCharsets.UTF_8
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, charset)
        finally:
            stream.close()
        return text.removesuffix(END) if text.endswith(END) else None

    def remove(self, name):
        self._fs.delete(self._at(name), True)
